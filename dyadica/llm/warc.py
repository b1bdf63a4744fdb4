"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by (page_id, a hash of payload and URL): cuts of equal bytes come from counts over ever finer
ranges of the id and, for an id that alone fills more than a range, of that hash; so they depend on the rows alone. A task
gets one range, writes its records in order, each as a gzip member, and begins another file when one has `roll_bytes` of
compressed bytes. A file is written under a temporary name and then moved to its final one; each range then gets a manifest
(files, records, bytes, digest) in the same way. A task that is run again writes the same bytes to the same names. Readers
read what manifests list. Further copies of a row that is a thousandth of all rows are revisits in ranges after the others.

Of records with equal payloads (SHA-1 and length) of at least `revisit_from` bytes, the first by page_id is a response,
the others are revisits of it, whose HTTP head still has the payload's length (of rows with that id, the one with the smallest url). The digest and the length in headers are
always made anew from the payload.

Defined results: a null html is an empty payload, a null url an empty target URI (line breaks in it become `%0A`, `%0D`); null ids come first and are
read back as null; of repeated rows with one payload and one id the first is the response and the others revisit it. An
empty table gives no files. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_common, table, written

ROLL_BYTES, RANGE_BYTES, FINER, LAST = 512 << 20, 1 << 30, 1024, (1 << 63) - 1
NOTE, PAGE, AGAIN = 0, 1, 2
SAME = ("page_id", "url", "digest")
#: Where a row is sorted: null ids first.
PLACE = {"id": "coalesce(page_id, -9223372036854775807 - 1)", "sub": "shiftrightunsigned(xxhash64(digest, url), 1)"}
DATE = "1970-01-01T00:00:00Z"  # of every record: archives of equal rows are equal
VERSION = "WARC/1.1"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _cuts(rows: DataFrame, spans: list[tuple[int, int, int]], target: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Upper ends (prefix, value) of ranges of about `target` of `weight` within spans (prefix, low, high), by counts over ever finer cells; and the values that weigh more alone. rows: prefix, value, weight."""
    todo, ends, heavy = spans, [], []
    while todo:  # a round for each factor FINER between a span's width and a range's
        steps = [(p, lo, hi, -(-(hi - lo + 1) // FINER)) for p, lo, hi in todo]
        bounds = rows.sparkSession.createDataFrame(steps, "prefix long, lo long, hi long, step long")  # as many as ranges that are too large
        inside = rows.join(F.broadcast(bounds), (rows["prefix"] == bounds["prefix"]) & rows["value"].between(bounds["lo"], bounds["hi"])).drop(rows["prefix"])
        cell = F.expr("CAST((CAST(value AS DECIMAL(20)) - lo) div step AS LONG)")
        cells = inside.groupBy("prefix", "lo", "step", cell.alias("cell")).agg(F.sum("weight").alias("weight")).orderBy("prefix", "lo", "cell").collect()
        todo, total, at = [], 0, None
        for c in cells:
            first, last = c["lo"] + c["cell"] * c["step"], c["lo"] + (c["cell"] + 1) * c["step"] - 1
            if at != (c["prefix"], c["lo"]):
                at, total = (c["prefix"], c["lo"]), 0
            if c["weight"] > target:
                ends += [(c["prefix"], first - 1), (c["prefix"], last)]
                if c["step"] > 1:
                    todo.append((c["prefix"], first, last))
                else:
                    heavy.append(first)
                total = 0
                continue
            if total and total + c["weight"] > target:
                ends.append((c["prefix"], first - 1))
                total = 0
            total += c["weight"]
    return ends, heavy


def cuts(rows: DataFrame, target: int) -> list[tuple[int, int]]:
    """Upper ends (id, sub) of ranges with about `target` of `weight` each. rows: id, sub (0 or above), weight. Only rows alike in both are never parted."""
    whole = rows.agg(F.min("id"), F.max("id")).first()
    if whole[0] is None:
        return []
    ends, heavy = _cuts(rows.select(F.lit(0).cast("long").alias("prefix"), F.col("id").alias("value"), "weight"), [(0, whole[0], whole[1])], target)
    within, _ = _cuts(rows.select(F.col("id").alias("prefix"), F.col("sub").alias("value"), "weight"), [(i, 0, LAST) for i in heavy], target) if heavy else ([], [])
    return sorted({*((e, LAST) for _, e in ends), *(e for e in within if e[1] >= 0)})


def record(kind: str, page_id: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record, not compressed. size: the payload's, which a revisit doesn't hold."""
    name = page_id or "null"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{digest}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Page-ID: {name}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if kind == "revisit":
        to = refers_to or "null"
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{to}:{digest}>", f"WARC-Refers-To-Page: {to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """data as a gzip member without time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, *, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, revisit_from: int = 0, folder: str | None = None) -> str:
    """Archives of pages (page_id, url, html) in `folder`, which is returned; by default a new one among the shared ones, which is deleted when the application ends."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")})
    facts = written(pages.groupBy(*SAME, "size").agg(F.count("*").alias("n")), "facts")  # without html
    groups = facts.where(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.min(F.struct("page_id", "url")).alias("first"), F.sum("n").alias("weight"))
    groups = written(groups.where("weight > 1"), "payloads")
    revisit = F.col("first").isNotNull() & ~(F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url")))
    facts = join_common(facts, groups, ["digest", "size"], "weight").select(*SAME, "size", "n", F.col("first.page_id").alias("refers_to"), revisit.alias("revisit"))
    facts = written(facts.withColumns({k: F.expr(v) for k, v in PLACE.items()}), "decided")
    total = facts.agg(F.sum("n")).first()[0] or 0
    ends = cuts(facts.select("id", "sub", (F.when(F.col("revisit"), 0).otherwise(F.col("size")) + 500 * F.col("n")).alias("weight")), range_bytes)

    # Payloads with a thousandth of all rows: their revisits are known where pages are read, and lose their html there.
    hot = F.broadcast(groups.where(F.col("weight") * 1000 >= total).limit(1000).select("digest", "size", "first"))
    known = pages.join(hot, ["digest", "size"], "left").withColumn("revisit", revisit)
    shape = ["page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to"), F.when(F.col("revisit"), AGAIN).otherwise(PAGE).alias("kind"), F.lit(1).cast("long").alias("n")]
    rows = known.select(*shape).withColumns({k: F.expr(v) for k, v in PLACE.items()})
    # A row that is so common itself is one row, and its further copies are revisits in ranges of their own.
    many = facts.where((F.col("n") > 1) & (F.col("size") >= revisit_from) & (F.col("n") * 1000 >= total)).limit(1000).orderBy(*SAME).collect()
    more, ranges = [], len(ends) + 1
    if many:
        common = spark.createDataFrame([tuple(r[c] for c in SAME) for r in many], "page_id long, url string, digest binary")
        alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SAME]
        marked = rows.join(F.broadcast(common.select(*[F.col(c).alias(f"_{c}") for c in SAME])), alike, "left")
        columns = rows.columns
        once = marked.where("_digest is not null").groupBy(*[c for c in columns if c != "html"]).agg(F.min("html").alias("html"))
        rows = marked.where("_digest is null").select(*columns).unionByName(once)
        step = max(1, range_bytes // 500)
        for r in many:
            to = r["refers_to"]
            for at in range(0, r["n"] - 1, step):
                more.append((r["page_id"], r["url"], None, r["digest"], r["size"], to, AGAIN, min(step, r["n"] - 1 - at), ranges))
                ranges += 1
    # Other revisits are told by rows of their own, sorted before their pages: so html is shuffled once.
    notes = facts.where("revisit").join(hot.select("digest", "size"), ["digest", "size"], "left_anti")
    notes = notes.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", "refers_to", F.lit(NOTE).alias("kind"), F.lit(1).cast("long").alias("n"), "id", "sub")
    shared = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, subs: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(shared.value, at) for at in zip(ids.tolist(), subs.tolist(), strict=True)], dtype="int32")

    placed = rows.unionByName(notes).withColumn("range", range_of("id", "sub"))
    if more:
        extra = spark.createDataFrame(more, "page_id long, url string, html string, digest binary, size long, refers_to long, kind int, n long, range int")
        placed = placed.unionByName(extra.withColumns({k: F.expr(v) for k, v in PLACE.items()}))
    order = ["range", F.col("page_id").asc_nulls_first(), "sub", "digest", F.col("url").asc_nulls_first(), "kind"]
    dealt = placed.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order)
    # Ids go as strings: pandas would round them beside nulls.
    sorted_rows = dealt.select("range", F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "size", F.col("refers_to").cast("string").alias("refers_to"), "kind", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        state: dict = {"range": None, "out": None, "files": [], "note": None, "served": None}

        def commit(temporary: str, final: str) -> None:
            try:
                system.move(temporary, final)
            except OSError:  # stores that don't move onto a file: it has the same bytes already
                system.delete_file(temporary)

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                commit(state["temporary"], f"{root}/{state['name']}")
                state["files"].append({"file": state["name"], "records": state["records"], "bytes": state["bytes"], "sha1": state["sha1"].hexdigest()})
                state["out"] = None

        def finish():
            close()
            if state["range"] is not None:
                final = f"{root}/manifest-{state['range']:08d}.json"
                temporary = f"{final}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as f:
                    f.write("".join(json.dumps(x) + "\n" for x in state["files"]).encode())
                commit(temporary, final)
                return pd.DataFrame(state["files"]).assign(range=state["range"])[["range", "file", "records", "bytes", "sha1"]]

        def put(data: bytes) -> None:
            if state["out"] is not None and state["bytes"] >= roll_bytes:
                close()
            if state["out"] is None:
                name = f"part-{state['range']:08d}-{len(state['files']):06d}.warc.gz"
                temporary = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
                state.update(name=name, temporary=temporary, out=system.open_output_stream(temporary, compression=None), records=0, bytes=0, sha1=hashlib.sha1())
            state["out"].write(data)
            state["sha1"].update(data)
            state["records"] += 1
            state["bytes"] += len(data)

        for batch in batches:
            for at, page_id, url, html, digest, size, refers_to, kind, n in zip(*(batch[c] for c in ("range", "page_id", "url", "html", "digest", "size", "refers_to", "kind", "n")), strict=True):
                page_id, url, refers_to = (None if pd.isna(x) else x for x in (page_id, url, refers_to))
                if at != state["range"]:
                    if (done := finish()) is not None:
                        yield done
                    state.update(range=int(at), files=[], note=None, served=None)
                row = (page_id, url, digest)
                if kind == NOTE:
                    state["note"] = (row, refers_to)
                    continue
                own = base64.b32encode(digest).decode()
                if kind == AGAIN:
                    data = record("revisit", page_id, url, None, size, own, refers_to)
                elif state["note"] is not None and state["note"][0] == row:
                    data = record("revisit", page_id, url, None, size, own, state["note"][1])
                elif state["served"] == row and size >= revisit_from:  # a further copy of the group's first
                    data = record("revisit", page_id, url, None, size, own, page_id)
                else:
                    data, state["served"] = record("response", page_id, url, html.encode(), size, own), row
                data = member(data)
                for _ in range(n):
                    put(data)
        if (done := finish()) is not None:
            yield done

    written(sorted_rows.mapInPandas(run, "range int, file string, records long, bytes long, sha1 string"), "manifest")
    return folder


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a gzip stream of records."""
    z, buffer, rest = zlib.decompressobj(31), bytearray(), b""
    ended = False
    while True:
        while (at := buffer.find(b"\r\n\r\n")) >= 0:
            headers = dict(line.split(": ", 1) for line in buffer[:at].decode().split("\r\n")[1:])
            end = at + 4 + int(headers["Content-Length"])
            if len(buffer) < end + 4:
                break
            yield headers, bytes(buffer[at + 4 : end])
            del buffer[: end + 4]
        if ended:
            return
        rest = rest or stream.read(1 << 20)
        if not rest:
            ended = True
            continue
        while rest:
            buffer += z.decompress(rest)
            rest = z.unused_data
            if not z.eof:
                rest = b""
                break
            z = zlib.decompressobj(31)
            if len(buffer) > 4 << 20:
                break


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of every record; payload is null in revisits."""
    system, root = filesystem(folder)
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    lists = [x.path for x in found if x.base_name.startswith("manifest-") and x.base_name.endswith(".json")]
    shape = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    if not lists:
        return spark.createDataFrame([], shape)
    manifests = spark.createDataFrame([(x,) for x in lists], "path string").repartition(min(len(lists), 1000))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = filesystem(folder)
        for batch in batches:
            for path in batch["path"]:
                with system.open_input_stream(path) as f:
                    yield pd.DataFrame({"path": [f"{root}/{json.loads(x)['file']}" for x in f.read().splitlines()]})

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = filesystem(folder)
        number = lambda x: pd.NA if x in (None, "null") else int(x)
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0

                def frame(rows):
                    types = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"}  # set before pandas can round
                    names = [c.split()[0] for c in shape.split(", ")]
                    return pd.DataFrame({c: pd.Series(v, dtype=types.get(c, object)) for c, v in zip(names, zip(*rows, strict=True), strict=True)})

                with system.open_input_stream(path, compression=None) as f:
                    for headers, block in parse(f):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        kind = headers["WARC-Type"]
                        rows.append((number(headers["WARC-Page-ID"]), headers["WARC-Target-URI"], kind, number(headers.get("WARC-Refers-To-Page")), headers["WARC-Payload-Digest"].removeprefix("sha1:"), size, body if kind == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return manifests.mapInPandas(files, "path string").repartition(min(4 * len(lists), 1000)).mapInPandas(records, shape)


def query(spark, sf_dir):
    folder = write(table(spark, sf_dir, "pages"), range_bytes=32 << 20)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1: 8 groups of 5 hexadecimal digits, each 4 characters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(digest, 5 * i + 1, 5) AS BIGINT)) AS parts FROM f)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(parts, lambda v: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
