"""What decontamination keeps of a long document: the parts that windows cover, not all of its shingles."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

from postroom.llm import decontamination
from postroom.session import cut_lineage


def test_only_covered_parts_are_stored(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [" ".join(word() for _ in range(n)) for n in (30, 45)]
    rows = []
    for i in range(20):
        words = [word() for _ in range(20_000)]
        at = rng.randrange(19_000)
        words[at : at + 30] = items[0].split()
        rows.append((i, " ".join(words)))
    rows += [(100, " ".join(word() for _ in range(300))), (101, items[1] + " end"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    cut_lineage(bench)  # the folder exists
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = stored()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.find(docs, bench).collect()}
    assert stored() - before < 1_000_000  # eight bytes for each shingle are 3.2 million
    assert got == {**{(i, 0): 1.0 for i in range(20)}, (101, 1): 1.0}
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()] == [100, 102]
