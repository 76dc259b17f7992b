"""WARC archives of pages: written with an index first, read back through it.

Writing: every task packs its pages into archives of its own, one gzip member a
record, and returns an index row for each record: archive, offset, length, URL
and payload digest.  Spark writes the index as one table; only archives named
there count, so a task that is repeated after a lost executor (or a second
attempt) leaves at most a file that nothing names.  Pages with equal payloads
are stored once, as the response with the largest identifier; the others become
revisit records that name it.

Reading: index rows are selected by any filter and dealt out by bytes: laid end to
end, the archives are cut into stretches of at most ``SPLIT_BYTES`` (fewer bytes where
that would leave cores idle), one task each.  Neighbours are coalesced into one
byte-range read each (gaps up to ``GAP_BYTES`` are read over, a read holds up to
``READ_BYTES`` unless one record is larger).  Archives are opened through
``pyarrow.fs`` by their URI.

Defined cases: null and empty payloads are records of 0 bytes and equal each
other; a null URL has no target field; repeated rows with the response's
identifier are responses too, pages without identifier revisit a named one if
there is one and are responses otherwise; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import open_store, scratch_path, staged

ARCHIVE_BYTES = 1 << 30
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Bytes of archives that one reading task is dealt.
SPLIT_BYTES, LEAST_SPLIT = 64 << 20, 1 << 20
PAGE_URN = "urn:page:"
WARC_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Identifiers cross to pandas as text: a column with nulls would become floating point there.
INDEX = "page_id string, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_IDS = ("page_id", "refers_to")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: str | None) -> str:
    return f"{PAGE_URN}{'' if page_id is None else page_id}"


def record_bytes(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_urn(page_id)}>"), ("WARC-Date", WARC_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size)),
               ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(0 if revisit else len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and payload of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return fields, block[:int(fields["content-length"])]


def _page_of(urn: str | None) -> str | None:
    return (urn or "").strip("<>").removeprefix(PAGE_URN) or None


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in _IDS if c in df.columns})


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages below the folder ``root`` and return the index.

    Payloads of fewer than ``least_bytes`` bytes are never revisits.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digested = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    groups = staged(digested.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("digest", "keeper"), "warc-groups")
    # Both sides are plain scans, so a digest with very many pages is split at run time.
    typed = digested.join(groups, "digest", "left").withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made = []
                for page, url, payload, digest, size, keeper, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "size", "keeper", "revisit"))):
                    raw = record_bytes(page, url, bytes(payload), int(size), digest, keeper, bool(revisit))
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(member)
                    made.append((page, url, f"{root}/{name}", at, len(member), int(size), digest, "revisit" if revisit else "response"))
                    at += len(member)
                yield pd.DataFrame(made, columns=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    path = f"{root}/index"
    sent = typed.select(F.col("page_id").cast("string"), "url", "payload", "digest", "size", F.col("keeper").cast("string"), "revisit")
    sent.mapInPandas(write, INDEX).write.parquet(path)
    return _numbered(pages.sparkSession.read.schema(INDEX).parquet(path))


def _dealt(selected: DataFrame) -> DataFrame:
    """The records (archive, offset, length) of each task, in order: tasks hold equal stretches of the archives.

    Only one row for each archive passes the window.
    """
    rows = selected.select("archive", "offset", "length")
    ends = rows.groupBy("archive").agg(F.max(F.col("offset") + F.col("length")).alias("end"))
    before = F.sum("end").over(Window.orderBy("archive").rowsBetween(Window.unboundedPreceding, -1))
    places = staged(ends.select("archive", "end", F.coalesce(before, F.lit(0)).alias("base")), "warc-places")
    total = places.agg(F.sum("end")).first()[0] or 0
    cores = selected.sparkSession.sparkContext.defaultParallelism
    split = min(SPLIT_BYTES, max(LEAST_SPLIT, -(-total // (2 * cores))))
    part = F.floor((F.col("base") + F.col("offset")) / split).cast("int")
    placed = rows.join(places.select("archive", "base"), "archive").select("archive", "offset", "length", part.alias("part"))
    return placed.repartitionById(total // split + 1, "part").drop("part").sortWithinPartitions("archive", "offset")


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name, parsed, with the digest and size of what was read.

    A revisit has no payload of its own; its digest and size are those it states.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = {}

        def records(archive: str, group: list[tuple[int, int]]) -> pd.DataFrame:
            if archive not in opened:
                for other in list(opened):
                    opened.pop(other).close()
                store, path = open_store(archive)
                opened[archive] = store.open_input_file(path)
            start = group[0][0]
            got = opened[archive].read_at(group[-1][0] + group[-1][1] - start, start)
            found = []
            for offset, length in group:
                fields, payload = parse_record(zlib.decompress(got[offset - start:offset - start + length], 31))
                page, revisit = _page_of(fields["warc-record-id"]), fields["warc-type"] == "revisit"
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload is not the one that was written")
                url = fields.get("warc-target-uri")
                url = None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
                found.append((page, url, int(fields["x-payload-length"]) if revisit else len(payload), digest, fields["warc-type"],
                              _page_of(fields.get("warc-refers-to")), *([payload] if with_payload else [])))
            names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload
            return pd.DataFrame(found, columns=names)

        archive, group = None, []
        for batch in batches:
            for name, offset, length in zip(batch["archive"], batch["offset"].tolist(), batch["length"].tolist()):
                if group and (name != archive or offset - sum(group[-1]) > GAP_BYTES or offset + length - group[0][0] > READ_BYTES):
                    yield records(archive, group)
                    group = []
                archive = name
                group.append((offset, length))
        if group:
            yield records(archive, group)
        for file in opened.values():
            file.close()

    return _numbered(_dealt(selected).mapInPandas(read, RECORD + ", payload binary" * with_payload))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All pages written to a fresh folder of the shared store and read back through the index."""
    root = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, root, least_bytes=least_bytes))
