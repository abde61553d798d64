"""WARC archives: written by Spark's text writer, read back by verified chains of records.

``write`` makes one archive per task. Of pages with equal payloads the one with the smallest id is a
response, the others are revisits that refer to it and carry no payload of their own.

``read`` opens archives in parts, as any text: lines by file, part and order. Nothing in a line tells a
record from a payload that quotes one, so

1. each task emits a candidate wherever a header block stands, with the offset of its successor (the
   end of the header, the stated length and two line ends), and the size of its part; a header that a
   part's end cuts is completed with the first lines of as many next parts as it reaches into;
2. sums of sizes turn offsets within parts into offsets in files, and pointer jumping from the start of
   each file marks the candidates that a chain of records reaches: pointers double every round, so
   rounds grow with the logarithm of the records per file. A quoted header is never reached;
3. tasks walk each part once more from its first verified record. What a part's end cuts off is put
   together by record; all else is read in place. For each part only its first record and the record
   that reaches into it are sent to the tasks, a few numbers per part.

Digests are SHA-1 of the full payload in upper-case base32 without padding, recomputed when reading.

A null text is an empty payload. A null URL is empty, line ends in URLs are dropped. Rows without an id
are written and come back without one; a group of equal payloads without any id is all responses. Rows
that repeat a response are responses too. Other columns are not read. An empty table gives an empty
result. A chain that breaks off ends its file's records there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

VERSION = "WARC/1.1"
MAGIC = b"WARC/1."
END = "\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_ROUNDS = 60
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    digest = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One text per row of ``pages`` (page_id, url, html): a record up to its closing line ends."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.translate(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r\n", "").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.select("*", sha1_base32(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest")
    groups = groups.agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    # stored, so that its size is known: payloads are shuffled only if repeated ones are many
    rows = rows.join(cut(groups), "digest", "left")
    again = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    only = lambda text: F.when(F.col("again"), text).otherwise("")
    return rows.select(
        F.concat(
            F.lit(VERSION + END),
            line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
            line("WARC-Record-ID", _urn(F.col("page_id"))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            only(line("WARC-Profile", F.lit(PROFILE))),
            only(line("WARC-Refers-To", _urn(F.col("first")))),
            only(line("X-Payload-Length", F.col("size").cast("string"))),
            line("Content-Type", F.lit("text/html")),
            line("Content-Length", F.when(F.col("again"), 0).otherwise(F.col("size")).cast("string")),
            F.lit(END),
            F.when(F.col("again"), "").otherwise(F.col("html")),
        ).alias("record")
    )


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` below ``path``, one per task."""
    records(pages).write.option("lineSep", END + END).option("compression", "none").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", END).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and size of the header block that ``raw`` starts with, or None."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(MAGIC) or end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes | None]]:
    """(file, block, line) in order; a line of None closes each part."""
    now = None
    for batch in batches:
        for file, block, line in zip(*(batch.column(i) for i in range(3)), strict=True):
            key = (file.as_py(), block.as_py())
            if now is not None and key != now:
                yield *now, None
            now = key
            yield *key, line.as_py()
    if now is not None:
        yield *now, None


_SCAN = pa.schema(
    {"kind": pa.string(), "file": pa.string(), "block": pa.int64(), "at": pa.int64(), "to": pa.int64(), "raw": pa.binary()}
)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind "c" (candidate, successor), "p" (whether a part's first lines end in it, its size, the lines) and "t" (a cut header)."""
    out: list[tuple] = []
    at, head, heading, block_of, start = 0, [], True, None, 0
    for file, block, line in _parts(batches):
        if line is None:
            if block_of is not None:
                out.append(("t", file, block, start, None, b"\r\n".join(block_of) + b"\r\n"))
            out.append(("p", file, block, int(not heading), at, b"".join(x + b"\r\n" for x in head)))
            at, head, heading, block_of = 0, [], True, None
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), _SCAN.types, strict=True)], schema=_SCAN)
                out = []
            continue
        if heading:
            # what may belong to a header that an earlier part began: lines of fields and the empty one
            if line == b"" or b":" in line:
                head.append(line)
            heading = b":" in line
        if line.startswith(MAGIC):
            block_of, start = [line], at
        elif block_of is not None:
            block_of.append(line)
            if line == b"":
                known = _header(b"\r\n".join(block_of) + b"\r\n")
                if known:
                    out.append(("c", file, block, start, start + known[1] + int(known[0]["content-length"]) + 4, None))
                block_of = None
            elif b":" not in line:
                block_of = None
        at += len(line) + 2
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), _SCAN.types, strict=True)], schema=_SCAN)


def _completed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            known = _header(bytes(row.raw) + b"".join(bytes(x["raw"]) for x in row.following))
            if known:
                rows.append((row.file, row.block, row.at, row.at + known[1] + int(known[0]["content-length"]) + 4))
        yield pd.DataFrame(rows, columns=["file", "block", "at", "to"])


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) that the chain from offset 0 of each file reaches, by doubling pointers (file, at, to)."""
    now = cut(edges.select("file", "at", "to", (F.col("at") == 0).alias("mark")))
    for _ in range(MAX_ROUNDS):
        ahead = now.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        stepped = now.join(ahead, ["file", "to"], "left")
        # where the successor is no candidate the pointer stays, past the last record
        moved = stepped.select("file", "at", F.coalesce("far", "to").alias("to"), "mark")
        marked = now.where("mark").select("file", F.col("to").alias("at"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("mark"))
        both = moved.unionByName(marked).groupBy("file", "at").agg(F.max("to").alias("to"), F.max("mark").alias("mark"))
        before = now
        now = cut(both.where("to is not null"))
        if now.where("mark").count() == before.where("mark").count() and now.join(
            before, ["file", "at", "to"], "left_anti"
        ).isEmpty():
            return now.where("mark").select("file", "at")
    raise RuntimeError(f"chains did not settle within {MAX_ROUNDS} rounds")


_FOUND = "file string, at long, seq long, raw binary, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdecimal() else None


def _fields(raw: bytes) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record."""
    known = _header(raw)
    if known is None:
        return None
    fields, size = known
    page, kind = _page(fields.get("warc-record-id", "")), fields.get("warc-type", "")
    if kind == "revisit":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        return page, int(fields.get("x-payload-length", "0")), digest, kind, _page(fields.get("warc-refers-to", ""))
    payload = raw[size : size + int(fields["content-length"])]
    return page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives below ``path``."""
    lines = _lines(spark, path)
    scanned = cut(lines.mapInArrow(_candidates, "kind string, file string, block long, at long, to long, raw binary"))
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    parts = scanned.where("kind = 'p'").select(
        "file",
        "block",
        F.coalesce(F.sum("to").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("at").over(earlier), F.lit(0)).alias("ended"),
        F.col("at").alias("ends"),
        "raw",
    )
    parts = cut(parts)
    placed = scanned.where("kind <> 'p'").join(parts.drop("raw"), ["file", "block"]).withColumns(
        {"at": F.col("at") + F.col("base"), "to": F.col("to") + F.col("base")}
    )
    whole = placed.where("kind = 'c'").select("file", "block", "at", "to")
    # a cut header goes on through parts of nothing but its lines, to the first part in which such lines end
    ahead = parts.select("file", F.col("ended").alias("before"), F.struct("block", "raw").alias("next"))
    cuts = placed.where("kind = 't'").select("file", "block", "at", "raw", (F.col("ended") + F.col("ends")).alias("before"))
    cuts = cuts.join(ahead, ["file", "before"]).where("next.block > block").groupBy("file", "block", "at")
    cuts = cuts.agg(F.first("raw").alias("raw"), F.sort_array(F.collect_list("next")).alias("following"))
    edges = cut(whole.unionByName(cuts.mapInPandas(_completed, "file string, block long, at long, to long")))
    chain = edges.join(reachable(edges), ["file", "at"], "left_semi").groupBy("file", "block")
    chain = chain.agg(F.min("at").alias("entry"), F.max("at").alias("last"))
    walk = parts.select("file", "block", "base").join(chain, ["file", "block"], "left")
    walk = walk.select("file", "block", "base", "entry", F.last("last", ignorenulls=True).over(earlier).alias("owner"))
    # one row per part of a file: a few numbers for every 128 MB of archives
    sent = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["base"], r["entry"], r["owner"]) for r in walk.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            {
                "file": pa.string(), "at": pa.int64(), "seq": pa.int64(), "raw": pa.binary(), "page_id": pa.int64(),
                "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
            }
        )
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        pos, begin, due, own = None, 0, None, []
        for file, block, line in _parts(batches):
            base, entry, owner = sent.value[(file, block)]
            if pos is None:
                pos = begin = base
                # due: where the record at hand ends; None while its header is incomplete
                due, own, at = (entry if entry is not None else 1 << 62), [], owner
            if line is None:
                if own and at is not None:
                    out.append((file, at, begin, b"".join(own), *[None] * 5))
                pos = None
                if len(out) > 200:
                    yield flush()
                continue
            if pos == due:
                if own and at is not None:
                    done = _fields(b"".join(own)) if begin == at else None
                    out.append((file, at, begin, None, *done) if done else (file, at, begin, b"".join(own), *[None] * 5))
                    if len(out) > 200:
                        yield flush()
                at = begin = pos
                due, own = None, []
            own += [line, b"\r\n"]
            pos += len(line) + 2
            if due is None and line == b"":
                known = _header(b"".join(own))
                due = at + known[1] + int(known[0]["content-length"]) + 4 if known else 1 << 62
        if out:
            yield flush()

    found = cut(lines.mapInArrow(run, _FOUND))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        done = _fields(b"".join(bytes(r) for r in frame["raw"]))
        return pd.DataFrame([done] if done else [], columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    pieces = found.where("raw is not null").select("file", "at", "seq", "raw").groupBy("file", "at").applyInPandas(joined, kinds)
    return found.where("raw is null").select(*columns).unionByName(pieces)
