"""Rules of the registered queries, in words that occur in their tables."""

from __future__ import annotations

from postroom.functions.lexicon import GateRules, GateStep, RiskRules, RiskStep, Rule

SCRIPTS = (("[äöüß]", "de"), ("[éèêç]", "fr"), ("[ñóí]", "es"))
DEFAULT_LANGUAGE = "en"
INSULTS = ("idiot", "stupid", "worthless", "loser", "clown")

FLAGS = (
    ("payment_change", ("thing", "pour")),
    ("churn_risk", ("nicht", "ciónes")),
    ("legal_risk", ("license", "stupid")),
    ("repeated_contact", ("antion",)),
    ("business_blocked", ("retion", "avec")),
)
VOTE = (
    ("refund", ("thing", "antion", "pour")),
    ("complaint", INSULTS + ("nicht",)),
    ("technical", ("token", "tionea", "lytion", "sting")),
    ("billing", ("license", "retion", "dans")),
    ("product_question", ("mente", "ciónes", "avec", "ingst")),
)
FIRST_MATCH = (
    ("refund", ("src13",)),
    ("technical", ("token", "idiot")),
    ("complaint", ("license", "clown")),
    ("billing", ("antion", "nicht", "dans")),
    ("product_question", ("retion", "mente", "avec")),
)
RISK = RiskRules(
    terms={
        "feature_words": ("thing", "onan", "les"),
        "failure_words": ("idiot", "nicht", "tiontion"),
        "money": ("antion", "pour"),
        "charge": ("retion", "dans"),
        "twice": ("erer", "lytion", "sur"),
        "question": ("erble", "que"),
        "legal": ("license", "stupid", "loser"),
        "production": ("anea", "de", "und"),
        "outage": ("onre", "ciónes", "von"),
    },
    derived={
        "feature_question": Rule((("feature_words",),), unless=("failure_words",)),
        "dispute": Rule((("charge", "twice"), ("money", "charge")), unless=("question",)),
    },
    steps=(
        RiskStep(Rule((("category:refund",), ("category:billing",)), unless=("feature_question",)), 2,
                 {"en": "Routine case needs review.", "de": "Routinefall prüfen."}),
        RiskStep(Rule((("category:complaint",),)), 2, {"en": "Complaint needs review.", "de": "Beschwerde prüfen."}),
        RiskStep(Rule((("money",),)), 2, {"en": "Money is involved.", "de": "Geld ist betroffen."}),
        RiskStep(Rule((("dispute",),)), 4, {"en": "Payment dispute.", "de": "Zahlungsstreit."}),
        RiskStep(Rule((("legal",),)), 4, {"en": "Legal exposure.", "de": "Rechtliches Risiko."}),
        RiskStep(Rule((("outage", "production"),)), 4, {"en": "Work is blocked.", "de": "Arbeit ist blockiert."}),
        RiskStep(Rule((("flag:legal_risk",),)), 4, {"en": "Legal exposure.", "de": "Rechtliches Risiko."}),
        RiskStep(Rule((("flag:business_blocked", "production"),)), 4, {"en": "Impact confirmed.", "de": "Wirkung bestätigt."}),
    ),
    reset=Rule((("feature_question",),)),
    reset_below=4,
    reset_flags={"en": "Feature question only.", "de": "Nur eine Produktfrage."},
)
GATE = GateRules(
    terms={
        "direct_request": ("thing", "pour", "esos"),
        "business_request": ("antion", "dans"),
        "security_notice": ("token", "@mail"),
        "lifecycle_marketing": ("nicht", "thnd"),
        "unsubscribe": ("ungein", "thanea"),
        "policy_update": ("ciónes", "thwh"),
        "support_intent": ("retion", "sting", "avec"),
    },
    sender_terms={"platform": ("src1",)},
    either_terms={"notification": ("license", "clown", "src7"), "late_notification": ("idiot", "src1", "src4")},
    steps=(
        GateStep(Rule((("platform", "security_notice"),)), "platform security notice"),
        GateStep(Rule((("lifecycle_marketing", "unsubscribe"),), unless=("business_request",)), "lifecycle marketing"),
        GateStep(Rule((("platform", "policy_update"),)), "platform policy update"),
        GateStep(Rule((("platform",),), unless=("business_request",)), "platform without request"),
        GateStep(Rule((("platform",), ("notification",)), unless=("direct_request",)), "notification"),
        GateStep(Rule((("late_notification",),), unless=("support_intent",)), "late notification"),
    ),
    keep_reason="support intent",
)
SYNONYMS = (
    ("thing", "license", "pour"),
    ("antion", "retion", "nicht", "auf"),
    ("token", "erble", "thing thing"),
    ("onan", "erer", "dans"),
    ("worthless", "clown", "avec"),
)
VOCABULARY = {
    "refund": ("thing", "onan", "erth"),
    "technical": ("token", "idiot", "erer", "onre"),
    "complaint": ("license", "clown", "erst", "onnd"),
    "billing": ("antion", "nicht", "dans", "than", "ther", "for the"),
    "product_question": ("retion", "mente", "avec", "from", "with"),
}
TEMPLATES = (
    ("refund", "en", "default", "Hello {name}, about your refund ({category}). We check turn {turn}."),
    ("complaint", "en", "default", "Hello {name}, we are sorry. Your complaint is with a specialist."),
    ("other", "en", "default", "Hello {name}, thank you for turn {turn}."),
    ("refund", "de", "default", "Hallo {name}, zu Ihrer Erstattung."),
    ("other", "de", "default", "Hallo {name}, danke."),
    ("product_question", "fr", "default", "Bonjour {name}, voici la réponse."),
    ("other", "fr", "default", "Bonjour {name}, merci."),
    ("other", "es", "default", "Hola {name}, gracias."),
)
