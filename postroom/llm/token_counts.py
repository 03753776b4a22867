"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import arrow_map, held

CONTEXT_TOKENS = 4096
SPACE = "▁"  # how the vocabulary writes a blank
CACHED_CHUNKS = 400_000
CACHED_LENGTH = 48


class PairRanks:
    """Ranks of the pieces of a BPE vocabulary file, and where a text may be cut before merging.

    A cut is safe where no piece of two or more characters spans it: in front of a run of blanks,
    and around characters that no such piece holds.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb2.TrainerSpec.BPE or spec.precompiled_charsmap:
            raise ValueError("only BPE vocabularies without a normalisation table are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("unsupported handling of white space")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_fallback = model.trainer_spec.byte_fallback or any(p.type == kinds.BYTE for p in model.pieces)
        inner = {c for p in self.ranks if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            self.chunk = re.compile(r".+", re.DOTALL)
        else:
            alone = "".join(c for c in "\n\t\r" if c not in inner)
            self.chunk = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))

    def count(self, chunk: str) -> int:
        """Tokens of one chunk: initial symbols less merges, plus the bytes of unknown characters."""
        ranks, parts = self.ranks, list(chunk)
        n = tokens = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, len(pair)) for i in range(n - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if not left or j >= n or len(left) + len(parts[j]) != length:
                continue  # one of the two was merged meanwhile
            parts[i] = merged = left + parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            tokens -= 1
            if k < n:
                before[k] = i
                if (pair := merged + parts[k]) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, len(pair)))
            h = before[i]
            if h >= 0 and (pair := parts[h] + merged) in ranks:
                heapq.heappush(heap, (ranks[pair], h, len(pair)))
        if self.byte_fallback:
            tokens += sum(len(p.encode()) - 1 for p in parts if p and p not in ranks)
        return tokens


class ChunkCounts(dict):
    """Counts of the chunks seen by this process; emptied when full, so its size is bounded."""

    def __init__(self, pairs: PairRanks) -> None:
        super().__init__()
        self.pairs = pairs

    def __missing__(self, chunk: str) -> int:
        n = self.pairs.count(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = n
        return n


def chunk_counts(path: str) -> ChunkCounts:
    return held(("chunks", path), lambda: ChunkCounts(PairRanks(path)))


def count_tokens(text: str, counts: ChunkCounts) -> int:
    if not text:
        return 0
    pairs = counts.pairs
    return sum(map(counts.__getitem__, pairs.chunk.findall(pairs.prefix + text.replace(" ", SPACE))))


def measure(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = CONTEXT_TOKENS
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row.

    Null and empty texts have no bytes and no tokens. Rows repeat as they come, null keys stay null,
    an empty table gives an empty result; other columns are not read. Whole texts; one scan and a map.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def run(batch: dict[str, list]):
        counts = chunk_counts(path)
        for doc_id, value in zip(batch["doc_id"], batch["text"], strict=True):
            value = value or ""
            n = count_tokens(value, counts)
            yield doc_id, len(value.encode()), n, n > limit

    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def over_limit(docs: DataFrame, path: str, **options) -> DataFrame:
    """Only the rows of ``measure`` whose text does not fit."""
    return measure(docs, path, **options).filter(F.col("over_limit"))
