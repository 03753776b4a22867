"""Documents to sections to chunks, and reports over them.

Sectioning and packing work inside one document row with array functions, so a
corpus is chunked in the scan stage; rows are exploded only at the end. Computed
arrays go through the *outer* generators: for the plain ones the optimizer adds a
filter on the array's size, which computes the whole array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions import lexicon as lx
from postroom.functions import text as tx
from postroom.functions.matching import first_match


def clean_documents(documents: DataFrame, text: str, keep_paragraphs: bool = True) -> DataFrame:
    """Add ``clean_text`` and the report columns original_chars, cleaned_chars, noise_lines_removed."""
    return (
        documents.withColumn("_lines", tx.clean_lines(F.col(text)))
        .withColumn("_kept", tx.without_noise(F.col("_lines")))
        .withColumns(
            {
                "clean_text": tx.join_lines(F.col("_kept"), keep_paragraphs),
                "noise_lines_removed": F.size("_lines") - F.size("_kept"),
            }
        )
        .withColumns({"original_chars": F.length(text), "cleaned_chars": F.length("clean_text")})
        .drop("_lines", "_kept")
    )


def with_sections(
    documents: DataFrame,
    text: str,
    *,
    separator: str = tx.BLANK_LINES,
    heading=tx.section_heading,
    standalone=tx.is_standalone_heading,
    name: str = "sections",
) -> DataFrame:
    """Add an array of (section_title, blocks); a block with a heading opens a section.

    Section borders are the heading positions, so each section is a slice of the
    block array: no running state is needed. Blocks and borders are columns of
    their own because an expression inside a lambda is evaluated per element.
    """
    titled = F.transform(
        "_blocks", lambda block, i: F.struct(i.alias("at"), heading(block).alias("title"), standalone(block).alias("alone"))
    )
    opening = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("title"), F.lit(False).alias("alone")))
    starts = F.concat(opening, F.filter(titled, lambda mark: mark["title"] != ""))

    def section(mark: Column, i: Column) -> Column:
        following = F.coalesce(F.get("_starts", i + 1)["at"], F.size("_blocks"))
        first = mark["at"] + mark["alone"].cast("int")
        return F.struct(
            mark["title"].alias("section_title"),
            F.slice("_blocks", first + 1, F.greatest(following - first, F.lit(0))).alias("blocks"),
        )

    return (
        documents.withColumn("_blocks", tx.blocks(F.col(text), separator))
        .withColumn("_starts", starts)
        .withColumn(name, F.filter(F.transform("_starts", section), lambda s: F.size(s["blocks"]) > 0))
        .drop("_blocks", "_starts")
    )


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _packing(out: Column, current: Column) -> Column:
    return F.struct(out.alias("out"), current.alias("current"))


def _flush(current: Column) -> Column:
    return F.when(current != "", F.array(tx.strip(current))).otherwise(_no_strings())


def pack_sentences(units: Column, max_chars: int) -> Column:
    """Glue sentences up to ``max_chars``; a longer sentence is cut at fixed width."""

    def step(state: Column, unit: Column) -> Column:
        current = state["current"]
        glue = F.when(current.rlike("[。！？；]$"), F.lit("")).otherwise(F.lit(" "))
        joined = F.when(current == "", unit).otherwise(tx.strip(F.concat(current, glue, unit)))
        return (
            F.when(
                F.length(unit) > max_chars,
                _packing(F.concat(state["out"], _flush(current), tx.fixed_width(unit, max_chars)), F.lit("")),
            )
            .when(
                (current != "") & (F.length(joined) > max_chars),
                _packing(F.concat(state["out"], _flush(current)), unit),
            )
            .otherwise(_packing(state["out"], joined))
        )

    return F.aggregate(
        units, _packing(_no_strings(), F.lit("")), step, lambda state: F.concat(state["out"], _flush(state["current"]))
    )


def split_block(block: Column, max_chars: int) -> Column:
    """Pieces of at most ``max_chars``: the block, else its lines, else packed sentences."""

    def split_line(line: Column) -> Column:
        parts = tx.sentences(line)
        return F.when(F.size(parts) > 1, pack_sentences(parts, max_chars)).otherwise(tx.fixed_width(line, max_chars))

    def line_pieces(line: Column) -> Column:
        return F.when(F.length(line) <= max_chars, F.array(line)).otherwise(split_line(line))

    rows = F.filter(F.transform(tx.lines(block), tx.strip), lambda line: line != "")
    return F.when(F.length(block) <= max_chars, F.array(block)).otherwise(F.flatten(F.transform(rows, line_pieces)))


def pack_pieces(pieces: Column, max_chars: int, overlap_chars: int) -> Column:
    """Greedy packing: a full chunk closes and its tail opens the next one."""

    def step(state: Column, piece: Column) -> Column:
        current = state["current"]
        glue = F.when(piece.contains("\n") | piece.startswith("#"), F.lit("\n\n")).otherwise(F.lit(" "))
        joined = F.when(current == "", piece).otherwise(tx.strip(F.concat(current, glue, piece)))
        overlap = tx.tail_overlap(current, overlap_chars)
        carried = F.when(overlap == "", piece).otherwise(tx.strip(F.concat(overlap, glue, piece)))
        fits = F.when(F.length(carried) <= max_chars, carried).otherwise(piece)
        oversize = F.length(fits) > max_chars
        closed = F.concat(state["out"], _flush(current))
        return F.when(
            (current != "") & (F.length(joined) > max_chars),
            _packing(
                F.when(oversize, F.concat(closed, tx.fixed_width(fits, max_chars))).otherwise(closed),
                F.when(oversize, F.lit("")).otherwise(fits),
            ),
        ).otherwise(_packing(state["out"], joined))

    return F.aggregate(
        pieces, _packing(_no_strings(), F.lit("")), step, lambda state: F.concat(state["out"], _flush(state["current"]))
    )


def chunk_documents(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    title: str,
    source: str,
    max_chars: int = lx.CHUNK_CHARS,
    overlap_chars: int = lx.CHUNK_OVERLAP,
    separator: str = tx.BLANK_LINES,
    heading=tx.section_heading,
    standalone=tx.is_standalone_heading,
    category_rules=lx.FIRST_MATCH_CATEGORY,
) -> DataFrame:
    """One row per chunk: position, section, content, source, category, token estimate."""

    def packed(section: Column) -> Column:
        pieces = F.flatten(F.transform(section["blocks"], lambda block: split_block(block, max_chars)))
        return F.transform(
            pack_pieces(pieces, max_chars, overlap_chars),
            lambda content: F.struct(section["section_title"].alias("section_title"), content.alias("content")),
        )

    rows = (
        with_sections(documents, text, separator=separator, heading=heading, standalone=standalone, name="_sections")
        .withColumn("_chunks", F.flatten(F.transform("_sections", packed)))
        .select(key, title, source, F.posexplode_outer("_chunks").alias("position", "_chunk"))
        .filter(F.col("position").isNotNull())
    )
    category_text = F.lower(F.concat_ws("\n", F.col(source), F.col(title), F.col("_chunk.content")))
    return rows.withColumn("_category_text", category_text).select(
        key,
        "position",
        title,
        F.concat(F.col(source), F.lit("#chunk-"), (F.col("position") + 1).cast("string")).alias("chunk_source"),
        F.col("_chunk.section_title").alias("section_title"),
        F.col("_chunk.content").alias("content"),
        first_match("_category_text", category_rules).alias("category"),
        tx.word_count_tokens(F.col("_chunk.content")).alias("token_estimate"),
    )


def document_rollup(chunks: DataFrame, key: str) -> DataFrame:
    """Per document: chunks, characters, tokens, named sections, chunks with text."""
    named = F.when(F.col("section_title") != "", F.col("section_title"))
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).alias("content_chars"),
        F.sum("token_estimate").alias("token_estimate"),
        F.count_distinct(named).alias("section_count"),
        F.count_if(F.length("content") > 0).alias("chunks_with_text"),
    )


def document_listing(documents: DataFrame, chunks: DataFrame, versions: DataFrame, key: str, created_at: str) -> DataFrame:
    """Documents with chunk count and current version, newest first."""
    counted = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    current = versions.groupBy(key).agg(F.max("version_number").alias("current_version"))
    return (
        documents.join(counted, key, "left")
        .join(current, key, "left")
        .withColumns(
            {
                "chunk_count": F.coalesce("chunk_count", F.lit(0)),
                "current_version": F.coalesce("current_version", F.lit(0)),
            }
        )
        .orderBy(F.col(created_at).desc())
    )
