"""Default rule values: term lists, weights, thresholds, labels and notes.

Everything below is FIXED VALUES: results depend on these exact words and
numbers, so they are stated as they are. They are only defaults; every operator
takes its rules as an argument and runs with any other table of the same shape.

A *signal* is a named list of terms. A ``Rule`` combines signals: it holds when
every signal of at least one group in ``any_of`` is true and no signal in
``unless`` is.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    any_of: tuple[tuple[str, ...], ...]
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class RiskStep:
    """Raise the score to ``score`` and add the flag of the message language."""

    rule: Rule
    score: int
    flags: dict[str, str]


@dataclass(frozen=True)
class RiskRules:
    terms: dict[str, tuple[str, ...]]
    derived: dict[str, Rule]
    steps: tuple[RiskStep, ...]
    reset: Rule | None = None
    reset_below: int = 4
    reset_flags: dict[str, str] = field(default_factory=dict)
    levels: tuple[tuple[int, str], ...] = ((4, "high"), (2, "medium"))
    default_level: str = "low"
    default_language: str = "en"


@dataclass(frozen=True)
class GateStep:
    rule: Rule
    reason: str


@dataclass(frozen=True)
class GateRules:
    """Ordered rejection cascade over raw substring signals.

    ``terms`` are looked up in the message text, ``sender_terms`` in the sender
    and ``either_terms`` in both.
    """

    terms: dict[str, tuple[str, ...]]
    sender_terms: dict[str, tuple[str, ...]]
    either_terms: dict[str, tuple[str, ...]]
    steps: tuple[GateStep, ...]
    keep_reason: str = "The email contains customer support intent."


# ---------------------------------------------------------------------------
# FIXED VALUES: closed vocabularies
# ---------------------------------------------------------------------------
CATEGORIES = ("refund", "complaint", "technical", "billing", "product_question", "other")
METRIC_CATEGORIES = ("refund", "billing", "technical", "product_question", "complaint")
RISK_LEVELS = ("low", "medium", "high")
RELIABILITY_LEVELS = ("weak", "medium", "strong")
CORPUS_SUFFIXES = (".md", ".txt", ".pdf", ".docx", ".doc")
CLOSED_STATUSES = ("processed", "ready_to_send", "escalated", "sent")
ACTIVE_TICKETS = ("open", "assigned")

# FIXED VALUES: script ranges that decide the language tag, first match wins.
LANGUAGE_SCRIPTS = (("[一-鿿]", "zh"),)
DEFAULT_LANGUAGE = "en"

# ---------------------------------------------------------------------------
# FIXED VALUES: preprocessing flags (bounded terms)
# ---------------------------------------------------------------------------
PREPROCESS_FLAGS = (
    ("payment_change", ("refund", "退款", "退费")),
    ("churn_risk", ("cancel", "取消")),
    ("legal_risk", ("legal action", "legal threat", "lawyer", "sue", "法律行动", "律师", "起诉")),
    ("repeated_contact", ("third email", "第三次", "多次")),
    ("business_blocked", ("blocked", "阻塞", "无法使用")),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: category vote (raw terms), earliest rule wins ties
# ---------------------------------------------------------------------------
CATEGORY_VOTE = (
    ("refund", ("refund", "charged", "duplicate", "payment", "退款", "退费", "扣费", "重复扣费", "重复收费", "付款")),
    ("complaint", ("unhappy", "cancel", "third email", "nobody", "blocked", "投诉", "不满意", "取消", "没人处理", "第三次", "阻塞")),
    ("technical", ("login", "password", "token", "invalid", "access", "登录", "密码", "验证码", "令牌", "无效", "无法访问", "进不去")),
    ("billing", ("invoice", "billing", "receipt", "tax", "发票", "账单", "收据", "税务", "开票")),
    ("product_question", ("feature", "plan", "integration", "workspace", "产品", "功能", "套餐", "版本", "集成", "工作区")),
)
VOTE_NO_MATCH_CONFIDENCE = 0.58
VOTE_BASE_CONFIDENCE = 0.72
VOTE_STEP_CONFIDENCE = 0.07
VOTE_MAX_CONFIDENCE = 0.94

# FIXED VALUES: first-match category, two tiers (raw terms)
FIRST_MATCH_CATEGORY = (
    ("refund", ("refund",)),
    ("technical", ("login", "troubleshooting")),
    ("complaint", ("escalation", "playbook")),
    ("product_question", ("product", "faq")),
    ("refund", ("refund", "duplicate charge", "charged twice", "退款", "重复扣费", "重复收费")),
    ("technical", ("login", "password", "token", "sso", "登录", "密码", "无法访问", "重置")),
    ("complaint", ("complaint", "cancel", "legal", "blocked", "投诉", "取消", "法律", "律师", "阻塞")),
    ("billing", ("invoice", "billing", "receipt", "tax", "发票", "账单", "收据", "税务")),
    ("product_question", ("feature", "plan", "integration", "workspace", "功能", "套餐", "版本", "集成")),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: risk (bounded terms)
# ---------------------------------------------------------------------------
RISK = RiskRules(
    terms={
        "capability_words": (
            "does pro", "can pro", "does the pro", "what actions are included", "roles and permissions",
            "different access levels", "是否支持", "是否包含", "可以保留哪些", "记录哪些操作", "包含登录", "成员权限",
        ),
        "failure_words": (
            "failed", "unavailable", "not working", "cannot access", "locked",
            "失效", "失败", "不可用", "无法访问", "被锁",
        ),
        "evidence_question": (
            "what should i provide", "which documents should", "what evidence",
            "需要哪些资料", "应该提供", "要提供哪些", "为了核对",
        ),
        "money": ("refund", "charged", "duplicate charge", "payment", "退款", "退费", "扣费", "重复收费", "支付"),
        "paperwork": (
            "invoice", "billing", "receipt", "tax id", "purchase order", "procurement",
            "发票", "账单", "收据", "税号", "采购订单", "企业采购",
        ),
        "account_access": (
            "login", "password", "verification code", "oauth", "mfa", "access",
            "登录", "密码", "验证码", "授权", "多因素认证", "无法访问",
        ),
        "commercial": (
            "pricing", "quotation", "discount", "contract terms", "compliance", "dpa",
            "报价", "折扣", "合同条款", "合规", "安全白皮书",
        ),
        "charge": ("charge", "charged", "payment", "扣费", "扣款", "支付"),
        "twice": (
            "duplicate charge", "duplicate payment", "charged twice", "two identical", "twice this month",
            "重复扣费", "重复收费", "重复支付", "扣了两次", "两笔相同",
        ),
        "unauthorized": ("unauthorized", "not approve", "未授权", "没有批准"),
        "renewed": ("renewal", "charged", "续费", "扣款", "扣费"),
        "cancelled": ("cancelled", "canceled", "cancel subscription", "取消", "已取消"),
        "still_charged": ("still charged", "charged automatically", "仍被扣", "仍然续费", "仍被扣款"),
        "material_refund": (
            "large refund", "refund dispute", "cross-currency", "mistaken annual purchase",
            "trial converted to a paid", "converted to a paid subscription",
            "大额退款", "退款争议", "跨币种", "误购买", "误操作购买",
        ),
        "security_legal": (
            "account stolen", "account compromised", "unknown device", "sensitive permission", "data leak",
            "data breach", "personal data", "privacy officer", "delete data", "lawyer", "legal action", "sue",
            "账号被盗", "未知设备", "敏感权限", "数据泄露", "个人数据", "隐私负责人", "删除数据", "律师", "法律行动", "起诉",
        ),
        "production": (
            "production", "core workflow", "core page", "core synchronization", "core task",
            "multiple workspaces", "multiple team members", "entire team",
            "生产", "核心流程", "核心页面", "核心任务", "同步任务", "多个工作区", "多个团队成员", "整个团队", "停工",
        ),
        "outage": (
            "outage", "incident", "unavailable", "timed out", "timeout", "blocked", "cannot work", "failed", "e503",
            "故障", "中断", "不可用", "超时", "受阻", "无法使用", "大量失败", "六成",
        ),
        "widespread": (
            "sixty percent", "most core", "forty people", "two departments", "impact is growing",
            "六成", "大量执行失败", "40 人", "两个部门", "错误仍在扩大",
        ),
        "auth_blocked": (
            "account locked", "locked account", "mfa loop", "mfa is looping", "mfa, the page returns",
            "authentication loop", "multiple reset", "sensitive oauth",
            "账号被锁", "账号锁定", "认证循环", "多因素认证循环", "多次重置", "敏感 oauth",
        ),
        "escalated": (
            "formal complaint", "very dissatisfied", "very unhappy", "supervisor", "manager take over",
            "followed up three", "third follow", "lawyer will contact", "close our account",
            "close our enterprise account", "escalate this", "generic processing message", "tell me the owner",
            "next update time", "missed its sla", "no response for", "ignored the evidence",
            "投诉", "非常不满", "主管", "接手", "催促三次", "跟进三次", "律师联系", "关闭企业账号", "模板回复",
            "请升级", "要求明确负责人", "告诉我负责人", "下一次更新时间", "超过 sla", "违反高优先级 sla",
            "没有答复", "没有解决",
        ),
    },
    derived={
        "capability_question": Rule((("capability_words",),), unless=("failure_words",)),
        "routine_issue": Rule((("category:refund",), ("category:billing",), ("category:technical",)),
                              unless=("capability_question",)),
        "payment_dispute": Rule(
            (("charge", "twice"), ("unauthorized", "renewed"), ("cancelled", "still_charged"), ("material_refund",)),
            unless=("evidence_question",),
        ),
    },
    steps=(
        RiskStep(Rule((("routine_issue",),)), 2, {
            "en": "Routine financial or technical issue requires review.", "zh": "常规财务或技术问题需要谨慎处理。"}),
        RiskStep(Rule((("category:complaint",),)), 2, {
            "en": "Customer complaint requires careful review.", "zh": "客户投诉需要谨慎审核。"}),
        RiskStep(Rule((("money",),)), 2, {
            "en": "Financial action or refund is involved.", "zh": "邮件涉及退款或资金处理。"}),
        RiskStep(Rule((("paperwork",),)), 2, {
            "en": "Billing or procurement handling is required.", "zh": "邮件涉及账单、发票或采购处理。"}),
        RiskStep(Rule((("account_access",),), unless=("capability_question",)), 2, {
            "en": "Account access or technical troubleshooting is required.", "zh": "邮件涉及账号访问或技术排查。"}),
        RiskStep(Rule((("commercial",),), unless=("capability_question",)), 2, {
            "en": "Commercial or compliance commitment needs specialist review.",
            "zh": "商业或合规承诺需要专业团队审核。"}),
        RiskStep(Rule((("payment_dispute",),)), 4, {
            "en": "A material payment dispute requires escalation.", "zh": "存在实质性资金争议，需要升级处理。"}),
        RiskStep(Rule((("security_legal",),)), 4, {
            "en": "Security, privacy, or legal exposure requires escalation.",
            "zh": "存在安全、隐私或法律风险，需要升级处理。"}),
        RiskStep(Rule((("outage", "production"), ("outage", "widespread"))), 4, {
            "en": "Production or multi-user business operations are blocked.", "zh": "生产环境或多人业务流程受阻。"}),
        RiskStep(Rule((("auth_blocked",),)), 4, {
            "en": "Account security or authentication failure blocks access.", "zh": "账号安全或认证故障阻断访问。"}),
        RiskStep(Rule((("escalated",),)), 4, {
            "en": "Escalated customer dissatisfaction requires supervisor review.",
            "zh": "客户不满或重复催促已经升级，需要主管审核。"}),
        RiskStep(Rule((("flag:legal_risk",),)), 4, {
            "en": "Preprocessing detected legal language.", "zh": "预处理检测到法律风险。"}),
        RiskStep(Rule((("flag:repeated_contact",),)), 4, {
            "en": "Preprocessing detected repeated customer contact.", "zh": "预处理检测到客户重复联系。"}),
        RiskStep(Rule((("flag:business_blocked", "production"),)), 4, {
            "en": "Preprocessing confirmed material business impact.", "zh": "预处理确认存在明显业务影响。"}),
    ),
    reset=Rule((("capability_question",),)),
    reset_below=4,
    reset_flags={
        "en": "Product capability question has no active failure or dispute signal.",
        "zh": "产品能力咨询未包含实际故障或争议信号。",
    },
)

# ---------------------------------------------------------------------------
# FIXED VALUES: relevance gate (raw terms)
# ---------------------------------------------------------------------------
PLATFORM_SENDERS = (
    "facebook", "facebookmail.com", "meta", "github", "google", "microsoft", "openai", "chatgpt",
    "email.openai.com", "nvidia", "ngc", "aws", "amazon", "stripe", "paypal", "apple", "icloud", "adobe",
    "atlassian", "slack", "notification", "notifications", "no-reply", "noreply", "donotreply", "newsletter",
    "updates", "qq邮箱团队",
)
NOTIFICATION_TERMS = (
    "unsubscribe", "no-reply", "noreply", "notification", "notifications", "unread", "new notification",
    "security alert", "login alert", "new login", "verification code", "sudo email verification code",
    "email_forward_notice", "privacy", "newsletter", "marketing", "promotion", "weekly update",
    "product update", "release notes", "recommendation", "digest", "community update", "retiring",
    "deprecation", "terms of service", "service terms", "privacy settings", "recommendation available",
    "new recommendation", "default directory", "welcome", "welcome to", "get started", "getting started",
    "onboarding", "activate your account", "complete your profile", "explore features", "product tour",
    "oauth application", "third-party oauth", "first-party github oauth", "authorized to access your account",
    "security events", "security-log", "settings/security-log", "do not forward this email", "facebook.com",
    "github.com/settings", "github.com/contact", "meta platforms",
    "退订", "动态更新", "新通知", "条新通知", "查看通知", "通知中心", "服务条款", "隐私设置", "更新后的",
    "推荐", "营销", "推广", "周报", "月报", "产品更新", "版本更新", "功能更新", "摘要", "即将停用", "退役",
    "下线", "登录提醒", "安全提醒", "验证码", "请勿转发", "如果不希望再收到", "了解详情",
)
LATE_NOTIFICATION_TERMS = (
    "unsubscribe", "no-reply", "noreply", "notification", "security alert", "login alert", "new login",
    "verification code", "email_forward_notice", "privacy", "newsletter", "oauth application",
    "third-party oauth", "authorized to access your account", "security events", "security-log",
    "settings/security-log", "do not forward this email", "退订", "动态更新", "新通知", "登录提醒",
    "安全提醒", "验证码", "请勿转发", "如果不希望再收到", "了解详情", "meta platforms", "facebook.com",
    "github", "google", "microsoft",
)
PLATFORM_SECURITY_REASON = "Detected platform security notification without a customer support request."
NOTIFICATION_REASON = (
    "Detected platform notification, security alert, newsletter, or unsubscribe-style email "
    "without a customer support request."
)
GATE = GateRules(
    terms={
        "direct_request": (
            "please help", "can you help", "i need help", "we need help", "need help", "please refund",
            "refund request", "invoice question", "billing issue", "cannot log in", "can't log in",
            "unable to access", "failed to access", "duplicate charge", "charged twice", "pro plan",
            "workspace issue", "请问", "请帮", "帮我", "协助", "需要帮助", "无法", "不能", "失败",
            "退款", "退费", "发票", "账单", "重复扣费", "重复收费", "套餐", "工作区",
        ),
        "business_request": (
            "please refund", "refund request", "invoice question", "billing issue", "cannot log in",
            "can't log in", "unable to access", "failed to access", "duplicate charge", "charged twice",
            "pro plan", "workspace issue", "退款", "退费", "发票", "账单", "重复扣费", "重复收费", "套餐",
            "工作区", "无法登录", "不能登录", "访问失败", "权限管理", "审计日志",
        ),
        "security_notice": (
            "oauth application", "third-party oauth", "first-party github oauth",
            "authorized to access your account", "security events", "security-log", "settings/security-log",
            "verification code", "sudo email verification code", "new login", "login alert", "security alert",
            "do not forward this email",
        ),
        "lifecycle_marketing": (
            "welcome", "welcome to", "get started", "getting started", "onboarding", "activate your account",
            "complete your profile", "explore features", "product tour",
        ),
        "unsubscribe": ("unsubscribe", "manage preferences", "email preferences", "opt out"),
        "policy_update": (
            "服务条款", "隐私设置", "terms of service", "privacy settings", "new recommendation",
            "recommendation available",
        ),
        "support_intent": (
            "refund", "invoice", "billing", "charged", "duplicate", "login", "password", "access", "workspace",
            "cannot", "can't", "failed", "issue", "problem", "退款", "退费", "发票", "账单", "扣费", "重复扣费",
            "登录", "密码", "无法", "不能", "帮", "帮助", "问题", "故障", "打不开", "开票", "保修", "订单", "物流",
        ),
    },
    sender_terms={"platform": PLATFORM_SENDERS},
    either_terms={
        "notification": NOTIFICATION_TERMS,
        "late_notification": LATE_NOTIFICATION_TERMS + PLATFORM_SENDERS,
    },
    steps=(
        GateStep(Rule((("platform", "security_notice"),)), PLATFORM_SECURITY_REASON),
        GateStep(
            Rule((("lifecycle_marketing", "unsubscribe"),), unless=("business_request",)),
            "Detected welcome or onboarding email with marketing unsubscribe signals and no concrete customer issue.",
        ),
        GateStep(
            Rule((("platform", "policy_update"),)),
            "Detected platform policy, privacy, or recommendation notification without a customer support request.",
        ),
        GateStep(
            Rule((("platform",),), unless=("business_request",)),
            "Detected platform sender without a strong customer business request.",
        ),
        GateStep(
            Rule((("platform",), ("notification",)), unless=("direct_request",)),
            "Detected platform notification, security alert, newsletter, or unsubscribe-style email "
            "without a direct customer support request.",
        ),
        GateStep(Rule((("late_notification",),), unless=("support_intent",)), NOTIFICATION_REASON),
        GateStep(
            Rule((("uncertain_other",),), unless=("support_intent",)),
            "The email does not contain a clear customer support intent.",
        ),
    ),
)

# FIXED VALUES: second gate, after the category is known (raw terms)
SECOND_GATE_TERMS = {
    "non_support": (
        "marketing", "promotion", "newsletter", "notification", "platform notification", "welcome email",
        "welcome message", "onboarding email", "getting started email", "security alert", "verification code",
        "oauth application", "policy update", "privacy settings", "terms of service", "recommendation",
        "digest", "no customer issue", "without a customer support request", "no customer support",
        "no direct customer request", "openai marketing", "product update", "system notification",
        "does not involve customer support", "not a customer support request", "not a support request",
        "not a support issue", "not a customer request", "营销", "推广", "通知", "平台通知", "安全提醒",
        "验证码", "隐私设置", "服务条款", "推荐", "无客户问题", "没有客户问题", "无客服问题", "无客户诉求",
        "没有客户诉求", "非客服", "营销邮件", "系统通知", "不涉及客户支持", "不涉及任何客户支持问题", "不涉及客服",
    ),
    "platform_sender": (
        "noreply", "no-reply", "notification", "openai", "chatgpt", "github", "facebook", "google",
        "microsoft", "nvidia", "ngc", "qq邮箱团队", "newsletter", "updates",
    ),
    "direct_request": (
        "please refund", "refund request", "charged twice", "duplicate charge", "invoice question",
        "billing issue", "cannot log in", "can't log in", "unable to access", "please help", "i need help",
        "we need help", "请帮", "帮我", "需要帮助", "无法", "不能", "退款", "退费", "发票", "账单",
        "重复扣费", "重复收费", "套餐", "工作区",
    ),
}
SECOND_GATE_REASONS = {
    "verdict": "Semantic analysis explicitly classified this message as not being a customer support request.",
    "analysis": (
        "Semantic analysis explicitly identified this email as non-support, marketing, notification, "
        "or without a customer issue."
    ),
    "signals": (
        "Semantic analysis identified this as a platform notification, marketing email, security alert, "
        "or message without a customer support request."
    ),
}
IRRELEVANT_NOTE = {
    "en": "Non-support email filtered out. No reply draft generated.",
    "zh": "非客服业务邮件，已拦截，不生成回复。",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: search terms, weights and thresholds
# ---------------------------------------------------------------------------
SHORT_SEARCH_TERMS = ("api", "sso", "mfa")
STOP_WORDS = (
    "about", "after", "again", "also", "and", "are", "before", "but", "can", "could", "does", "for", "from",
    "has", "have", "help", "how", "into", "need", "our", "please", "should", "that", "the", "their", "this",
    "through", "was", "what", "when", "where", "which", "will", "with", "would", "your",
)
CJK_STOP_WORDS = (
    "一个", "一些", "什么", "可以", "如何", "客户", "客服", "已经", "我们", "是否", "系统", "请问", "这个", "需要", "问题",
)
SYNONYM_GROUPS = (
    ("password", "reset", "expired", "密码", "重置", "过期"),
    ("login", "sign in", "access", "workspace", "登录", "访问", "工作区"),
    ("verification code", "code", "验证码"),
    ("oauth", "authorization", "permission", "permissions", "授权", "权限"),
    ("mfa", "multi factor", "多因素认证"),
    ("incident", "outage", "timeout", "timed out", "unavailable", "production", "blocked", "error", "status page",
     "故障", "中断", "超时", "不可用", "生产", "受阻", "错误", "状态页"),
    ("team", "members", "affected", "impact", "团队", "成员", "影响"),
    ("complaint", "unhappy", "dissatisfied", "投诉", "不满"),
    ("supervisor", "escalate", "priority", "主管", "升级", "优先级"),
    ("follow up", "repeated", "催促", "多次来信"),
    ("sla", "response time", "响应时间", "时效"),
    ("privacy", "personal data", "data export", "deletion", "隐私", "个人数据", "数据导出", "删除"),
    ("refund", "duplicate charge", "charged twice", "退款", "重复扣费"),
    ("authorization hold", "pending charge", "preauthorization", "预授权", "待处理扣款"),
    ("renewal", "cancelled", "cancellation", "续费", "取消订阅"),
    ("invoice", "billing", "receipt", "发票", "账单", "收据"),
    ("tax id", "invoice title", "credit note", "税号", "发票抬头", "红冲"),
    ("purchase order", "vendor", "quotation", "procurement", "采购订单", "供应商", "报价单", "采购"),
    ("plan", "pro", "feature", "套餐", "功能", "版本"),
    ("role", "roles", "read only", "角色", "只读"),
    ("audit log", "audit", "审计日志", "审计"),
    ("integration", "webhook", "api", "集成", "接口"),
    ("contract", "pricing", "discount", "合同", "报价", "折扣"),
)
CATEGORY_TERMS = {
    "product_question": (
        "product", "feature", "plan", "pro", "workspace", "team", "permission", "permissions", "audit", "logs",
        "integration", "integrations", "sso", "webhook", "api", "role", "roles", "read only", "priority support",
        "compliance", "pricing", "contract", "产品", "功能", "套餐", "版本", "团队", "工作区", "协作", "权限",
        "管理", "审计", "日志", "集成", "角色", "只读", "优先支持", "合规", "报价", "合同",
    ),
    "refund": (
        "refund", "duplicate", "charge", "charged", "billing", "invoice", "payment", "authorization", "renewal",
        "cancelled", "cancellation", "original payment", "退款", "退费", "重复", "扣费", "收费", "账单", "支付",
        "发票", "预授权", "续费", "取消订阅", "原路退回",
    ),
    "billing": (
        "invoice", "billing", "receipt", "tax", "payment", "title", "vendor", "quotation", "purchase order",
        "contract", "bank transfer", "账单", "发票", "收据", "税务", "支付", "抬头", "供应商", "报价单",
        "采购订单", "合同", "转账",
    ),
    "technical": (
        "login", "password", "token", "sso", "access", "workspace", "reset", "verification code", "oauth", "mfa",
        "timeout", "incident", "outage", "production", "error", "status page", "登录", "密码", "重置", "访问",
        "工作区", "令牌", "验证码", "多因素认证", "超时", "故障", "服务异常", "生产环境", "错误码", "状态页",
    ),
    "complaint": (
        "complaint", "unhappy", "cancel", "legal", "blocked", "escalate", "supervisor", "incident", "outage",
        "production", "sla", "repeated", "follow up", "privacy", "data export", "投诉", "不满", "取消", "法律",
        "律师", "升级", "主管", "故障", "中断", "生产", "多次催促", "隐私", "数据导出",
    ),
}
RERANK_WEIGHTS = {"vector": 0.48, "keyword": 0.34, "category": 0.18}
RERANK_CEILING = 0.99
RERANK_CATEGORY_FLOOR = 0.24
RERANK_MINIMUM = 0.18
KEYWORD_TOP_TERMS = 6
KEYWORD_DIVISOR = 8.0
CATEGORY_BASE = 0.65
CATEGORY_RANGE = 0.35
RECALL_FACTOR = 8
RECALL_MINIMUM = 24
RELIABILITY_BANDS = ((0.6, "strong"), (0.35, "medium"))
MATCH_REASONS = {
    "vector_high": "语义相似度较高",
    "vector_some": "语义相关",
    "keyword_high": "关键词重合",
    "keyword_some": "存在少量关键词交集",
    "category": "邮件分类与知识分类一致",
    "default": "综合语义、关键词和分类信号命中",
}
READY_CONFIDENCE = 0.7
BULK_READY_CONFIDENCE = 0.78
NEAR_DUPLICATE_THRESHOLD = (92, 100)
SHINGLE_SIZE = 12
CHUNK_CHARS = 900
CHUNK_OVERLAP = 100
VECTOR_DIMENSIONS = 256

# ---------------------------------------------------------------------------
# FIXED VALUES: text quality markers
# ---------------------------------------------------------------------------
CORRUPT_MARKERS = (
    "锟", "閿", "�", "Ã", "Â", "浣", "犲", "ソ", "鏂", "鎬", "煡", "鐪", "閫", "氱", "洿", "规", "嵁", "涓",
    "湪", "瀹", "㈡", "湇",
)
COMMON_HANZI = "的一是在不了有和人这中大为上个我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经"
MOJIBAKE_MARKERS = (
    "锟", "閿", "�", "Ã", "Â", "¤", "¥", "¢", "ä", "å", "æ", "ç", "è", "é", "½", "¡",
    "浣", "犲", "ソ", "瑕", "侀", "€", "锛", "冿", "紝",
    "鏂", "鎬", "煡", "鐪", "閫", "氱", "洿", "规", "嵁", "涓", "湪",
    "娆", "瀹", "㈡", "湇", "绛", "伐", "佷", "叆", "妯", "婊", "卞", "勭",
    "瑞", "偶", "橱", "嫡", "皴", "仟", "软", "钧", "绮", "谩", "陲",
)
MOJIBAKE_RUNS = (
    (r"[ÃÂ][\u0080-\u00ffA-Za-z]{1,}", 3),
    (r"[äåæçèé][\u0080-\u00ffA-Za-z]{1,}", 3),
    ("[浣犲ソ鏂鎬煡鐪嬫湁涓侀氱洿规嵁瀹㈡湇]{2,}", 2),
)
LATIN1_PAIR_RUN = "(?:[ÃÂÄÅäåæçèé].){2,}"
COMMON_ENGLISH = (
    "the", "and", "for", "you", "your", "this", "that", "with", "from", "please", "thanks", "account", "email",
    "support", "security", "login", "subscription", "refund", "invoice", "team", "customer", "service", "plan",
    "access", "verify", "notification", "update",
)
READABLE_CLASS = "一-鿿A-Za-z0-9，。！？、；：,.!?;:'\"()\\[\\]《》<>/\\-_\\s"
PROTECTED_TOKEN = (
    r"https?://[^\s<>()]+"
    r"|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
    r"|(?:¥|￥|\$|€|£)\s?\d[\d,]*(?:\.\d+)?"
    r"|\b\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?\b"
    r"|\b[A-Z]{1,8}[-_]\d[A-Z0-9_-]*\b"
    r"|\b\d+(?:\.\d+)?%?\b"
)
EDIT_LENGTH_LIMIT = 0.22

# ---------------------------------------------------------------------------
# FIXED VALUES: prices, notes, labels
# ---------------------------------------------------------------------------
PRICES_PER_MILLION = {"input_tokens": 1.0, "output_tokens": 2.0, "embedding_tokens": 0.08}
REVIEW_NOTES = (
    ("zh", "approve", "审核通过，可以发送。"),
    ("zh", "revise", "审核要求修改回复草稿。"),
    ("zh", "escalate", "已升级给人工专员处理。"),
    ("zh", "undo_escalate", "已撤销升级，邮件回到人工审核队列。"),
    ("en", "approve", "Approved by reviewer."),
    ("en", "revise", "Reviewer requested changes."),
    ("en", "escalate", "Escalated to a human specialist."),
    ("en", "undo_escalate", "Escalation undone; the email is back in human review."),
)
ACTION_STATUS = {
    "approve": "ready_to_send",
    "revise": "needs_revision",
    "escalate": "escalated",
    "undo_escalate": "human_review",
}
TICKET_STATUS = {"assign": "assigned", "resolve": "resolved", "return_to_review": "returned"}
RISK_FLAG_LABELS = (
    ("verification test", "验证测试"),
    ("no user impact", "无用户影响"),
    ("unauthorized oauth access possible", "可能存在未授权 OAuth 访问"),
    ("third-party application with sensitive scopes", "第三方应用包含敏感权限范围"),
    ("legal", "涉及法务风险"),
    ("cancel", "客户存在取消合同风险"),
    ("blocked", "业务流程被阻塞"),
    ("third email", "客户多次联系"),
    ("duplicate", "疑似重复扣费"),
    ("refund", "涉及退款请求"),
    ("sensitive", "涉及敏感权限或敏感信息"),
)
SUFFIX_BY_CONTENT_TYPE = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
}
CSS_SIGNAL = r"(?i)[#.]?[A-Za-z0-9_-]+\s*\{|@\s*media|!important|mso-|box-sizing|font-size|line-height"
CSS_SIGNAL_MINIMUM = 4
CSS_HEAD_CHARS = 3000
CSS_ANCHOR_AFTER = 40
GREETING_ANCHORS = (
    (r"\bHi\s+[^,\n]{0,40},", r"\bHello\s+[^,\n]{0,40},", r"\bDear\s+[^,\n]{0,40},", "你好[，,]"),
    (r"\bSign In\b", r"\bView in browser\b"),
)
INTERNAL_LINE_PREFIXES = ("Reference used:", "参考依据：")
