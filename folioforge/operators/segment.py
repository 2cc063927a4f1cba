"""Segmentation: whole texts into chapters, paragraphs into blocks and back, places between the two."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPACE, lines, trim
from .clean import kind_of

# The heading pattern (Java syntax) and the title of what stands before the first heading.
HEADING = (
    r"\A(?:(?:番外|外传)?第[零〇一二三四五六七八九十百千万两0-9]+[章节回卷][^\n]{0,60}|(?:序章|序言|楔子|尾声|后记|完本感言|番外|致读者)[^。！？!?\n]{0,14}"
    rf"|Chapter[{SPACE}]+[0-9]+[^\n]{{0,60}}|[0-9]{{1,4}}[、.．][^\n]{{0,60}})\z"
)
FRONT = "正文"
BLOCK = 6000


def split_chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heading: str = HEADING) -> DataFrame:
    """doc_id, chapter (from 1), title, paragraphs. Blank lines go, headings without a body stay, text before any heading is a chapter
    of its own; chapters without paragraphs go unless a text has only that one. Null and blank texts give no rows."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines(F.col(text_col))).alias("pos", "line")).withColumn("line", trim(F.col("line"))).filter("line <> ''")
    each = each.withColumn("is_heading", F.col("line").rlike(heading))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("chapter", F.sum(F.col("is_heading").cast("int")).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))), lambda x: x["line"])
    found = each.groupBy("doc_id", "chapter").agg(F.coalesce(F.max(F.when(F.col("is_heading"), F.col("line"))), F.lit(FRONT)).alias("title"), body.alias("paragraphs"))
    own = Window.partitionBy("doc_id")
    found = found.withColumn("n", F.count("*").over(own)).filter((F.size("paragraphs") > 0) | (F.col("n") == 1))
    return found.withColumn("chapter", F.row_number().over(own.orderBy("chapter"))).drop("n")


def _units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def _groups(sizes: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of paragraphs that share a block: as many as fit with two units between them; one that is too long is alone."""
    first = 0
    while first < len(sizes):
        last, total = first, sizes[first]
        while last + 1 < len(sizes) and max(sizes[first], sizes[last + 1]) <= size and (not total or total + 2 + sizes[last + 1] <= size):
            last += 1
            total += 2 * (total > 0) + sizes[last]
        yield first, last
        first = last + 1


def _cuts(raw: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Places in UTF-16 units at which a long paragraph is cut; a surrogate pair stays whole."""
    begin, n = 0, len(raw) // 2
    while begin < n:
        end = min(begin + size, n)
        end -= end < n and 0xD8 <= raw[2 * end - 1] < 0xDC
        yield begin, end
        begin = end


def blocks_of(paragraphs: list[str], size: int = BLOCK) -> list[tuple[int, int, str, list[int]]]:
    """(first paragraph, last paragraph, text, offsets) of blocks of about ``size`` UTF-16 units. A paragraph's offset is where it starts in
    the block, negative if it began in an earlier one. Groups without any text have no block."""
    raws = [_units(p or "") for p in paragraphs]
    sizes = [len(r) // 2 for r in raws]
    out = []
    for first, last in _groups(sizes, size):
        if sizes[first] > size:
            out += [(first, first, raws[first][2 * a : 2 * b].decode("utf-16-le", "surrogatepass"), [-a]) for a, b in _cuts(raws[first], size)]
        elif any(sizes[first : last + 1]):
            offsets, at = [], 0
            for n in sizes[first : last + 1]:
                at += 2 * (at > 0)
                offsets.append(at)
                at += n
            out.append((first, last, "\n\n".join(p or "" for p in paragraphs[first : last + 1]), offsets))
    return out


#: Texts of which a worker holds the paragraphs at once.
SLICE = 200
_BLOCK_COLUMNS = ["doc_id", "block_index", "start_paragraph", "end_paragraph", "text", "offsets"]


def build_blocks(docs: DataFrame, id_col: str = "doc_id", paragraphs_col: str = "paragraphs", size: int = BLOCK) -> DataFrame:
    """doc_id, block_index, start_paragraph, end_paragraph, text, offsets."""

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(paragraphs_col).alias("paragraphs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Python objects are made for few texts at a time.
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                owners, rows = [], []
                for n, paragraphs in enumerate(part.column(1).to_pylist()):
                    found = [] if paragraphs is None else blocks_of(paragraphs, size)
                    owners += [n] * len(found)
                    rows += [(i, *b) for i, b in enumerate(found)]
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int32())), *columns], _BLOCK_COLUMNS)
                pa.default_memory_pool().release_unused()

    return own.mapInArrow(run, f"doc_id {kind}, block_index int, start_paragraph int, end_paragraph int, text string, offsets array<int>")


def restore_paragraphs(blocks: DataFrame) -> DataFrame:
    """doc_id, paragraphs: the inverse of build_blocks for paragraphs that are not empty and hold no blank line."""
    n = F.col("end_paragraph") - F.col("start_paragraph") + 1
    parts = F.when(n == 1, F.array("text")).otherwise(F.split("text", "\n\n", -1))
    each = blocks.select("doc_id", "block_index", F.col("start_paragraph"), F.posexplode(parts).alias("k", "part")).withColumn("paragraph", F.col("start_paragraph") + F.col("k"))
    whole = each.groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "part"))), lambda x: x["part"]), "").alias("text"))
    return whole.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]).alias("paragraphs"))


def anchors_to_blocks(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchors (doc_id, paragraph, offset) with block_index and block_offset: the last block that holds the place.

    A paragraph's blocks are found by equality on each paragraph that a block covers, not by comparing ranges.
    """
    covered = blocks.select("doc_id", "block_index", F.posexplode("offsets").alias("k", "at"), "start_paragraph").select("doc_id", "block_index", (F.col("start_paragraph") + F.col("k")).alias("paragraph"), "at")
    found = anchors.join(covered, ["doc_id", "paragraph"]).filter((F.col("at") >= 0) | (F.col("offset") >= -F.col("at")))
    best = F.max_by(F.struct("block_index", (F.col("offset") + F.col("at")).alias("block_offset")), "block_index")
    return found.groupBy("doc_id", "paragraph", "offset").agg(best.alias("b")).select("doc_id", "paragraph", "offset", "b.block_index", "b.block_offset")


def in_catalog_order(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, index) of lines that continue a catalog: of ``found`` (doc_id, at, places: the sorted indexes of entries with a line's words), each takes
    the first place that no earlier line has passed, if that is within ``window`` of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, after = object(), 0
        for batch in batches:
            kept, taken = [], []
            for k, (own, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own != owner:
                    owner, after = own, 0
                i = bisect_left(places, after)
                if i < len(places) and places[i] - after <= window:
                    kept.append(k)
                    taken.append(places[i])
                    after = places[i] + 1
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(taken, pa.int32())], ["doc_id", "at", "index"])

    kind = found.schema["doc_id"].dataType.simpleString()
    ordered = found.select("doc_id", "at", "places").repartition("doc_id").sortWithinPartitions("doc_id", "at")
    return ordered.mapInArrow(run, f"doc_id {kind}, at int, index int")


def align_to_catalog(keyed_lines: DataFrame, catalog: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, pos, catalog_index: lines (doc_id, pos, key, unindented) that match a catalog (doc_id, index, key) in order (see ``in_catalog_order``). Only lines
    whose key the catalog has are put in order."""
    places = catalog.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.col("index").cast("int"))).alias("places"))
    found = keyed_lines.filter("unindented").join(places, ["doc_id", "key"]).select("doc_id", F.col("pos").cast("int").alias("at"), "places")
    return in_catalog_order(found, window).select("doc_id", F.col("at").alias("pos"), F.col("index").alias("catalog_index"))


#: Matched headings by headings found, from which on an alignment with a catalog counts.
LEAST_MATCHED = 0.5


def aligned(matches: DataFrame, headings: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, missing): doc_id, matched, headings, accepted for each doc_id of ``headings`` (doc_id, headings: how many lines look like headings), and
    the entries (doc_id, index, key) of accepted catalogs that no line matched."""
    found = matches.groupBy("doc_id").agg(F.count("*").alias("matched"))
    books = headings.join(found, "doc_id", "left").select("doc_id", F.coalesce("matched", F.lit(0)).alias("matched"), "headings")
    books = books.withColumn("accepted", (F.col("matched") > 0) & (F.col("matched") >= F.col("headings") * LEAST_MATCHED))
    taken = matches.select("doc_id", F.col("catalog_index").alias("index"))
    missing = catalog.join(books.filter("accepted").select("doc_id"), "doc_id", "left_semi").join(taken, ["doc_id", "index"], "left_anti")
    return books, missing.select("doc_id", "index", "key")


def looks_like_heading(line: Column, numbered: str = r"\A第[零〇一二三四五六七八九十百千万两0-9]+[章节回卷]") -> Column:
    """A line at the margin of 40 characters at most that isn't advertising and, unless it is numbered, doesn't end a sentence."""
    own = trim(line)
    return ~line.rlike(r"\A[ \t\u3000]") & (own != "") & (F.length(own) <= 40) & (~own.rlike(r"[。…]\z") | own.rlike(numbered)) & (kind_of(own) == "kept")


def split_by_margin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chapter (from 1), title, paragraphs of texts whose headings stand at the margin and whose paragraphs are indented: the way for texts
    that no catalog fits. Blank and advertising lines go; headings without a body stay. Null and blank texts give no rows."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines(F.col(text_col))).alias("pos", "raw")).withColumn("line", trim(F.col("raw"))).filter("line <> ''")
    each = each.filter(kind_of(F.col("line")) == "kept").withColumn("is_heading", looks_like_heading(F.col("raw")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("at", F.sum(F.col("is_heading").cast("int")).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))), lambda x: x["line"])
    found = each.groupBy("doc_id", "at").agg(F.coalesce(F.max(F.when(F.col("is_heading"), F.col("line"))), F.lit(FRONT)).alias("title"), body.alias("paragraphs"))
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("chapter"), "title", "paragraphs")


def blocks_to_anchors(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """places (doc_id, block_index, block_offset) with paragraph and offset: the last paragraph of the block that starts at or before the place."""
    starts = blocks.select("doc_id", "block_index", "start_paragraph", F.posexplode("offsets").alias("k", "at"))
    found = places.join(starts, ["doc_id", "block_index"]).filter(F.col("at") <= F.col("block_offset"))
    best = F.max_by(F.struct((F.col("start_paragraph") + F.col("k")).alias("paragraph"), (F.col("block_offset") - F.col("at")).alias("offset")), "k")
    return found.groupBy("doc_id", "block_index", "block_offset").agg(best.alias("p")).select("doc_id", "block_index", "block_offset", "p.paragraph", "p.offset")
