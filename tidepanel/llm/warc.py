"""WARC archives: monolithic gzip files, normalised to one gzip member per record with a sidecar offset index.

Archives are written and read with Spark's text and binary-file sources only, so they may lie in any store that Spark reaches.
"""

import hashlib
import zlib
from itertools import islice

import pandas as pd
from pyspark.sql import functions as F

from tidepanel.llm.common import new_folder, table, text_or_empty

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 1000
#: Records of an archive file. With pages of 100 KB it stays under 100 MB, which one task holds.
RECORDS = 1000
#: Compressed bytes that are inflated at a time, and the deflate level of a member.
SLICE, LEVEL = 1 << 16, 4

_END = "\r\n\r\n"


def assign_types(pages, least=LEAST_REVISIT):
    """``page_id, url, html`` -> the same with payload_bytes, payload_digest (hex SHA-1), refers_to.

    Of the pages with equal payloads of at least ``least`` bytes, the one with the largest id is the response, the others refer
    to it. Groups are reduced to their largest id before the join, so one side has a row per payload and a payload that a third of
    all pages share can be split over tasks. Repeated rows of the page with the largest id are a response each. A row with a
    null id is a response; null html is an empty payload.
    """
    html = text_or_empty("html")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
    groups = p.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "last")
    joined = p.join(groups, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("page_id") < F.col("last")) & (F.col("payload_bytes") >= least), F.col("last"))).drop("last")


def record(typed):
    """Each page as the text of its WARC record, without the two line ends after it."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END)
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", name("page_id")),
        ("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("WARC-Refers-To", F.when(revisit, name("refers_to"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise(F.lit("")) for k, v in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block)


def write_monolithic(typed, folder, records=RECORDS):
    """Archives of whole-file gzip streams: all records of a file in one member."""
    typed.select(record(typed).alias("value")).write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", records).text(folder)


def records_of(content, size=SLICE):
    """The records of a gzip file, each with its two line ends, inflated slice by slice. Any number of members is read."""
    if content[:1] in (b"", b"\0"):
        return  # no member: an archive of no records is padding alone
    inflate, data, at = zlib.decompressobj(31), bytearray(), 0
    while True:
        # a header tells how long its record is
        head = data.find(b"\r\n\r\n")
        if head >= 0:
            length = next(int(x[15:]) for x in bytes(data[:head]).split(b"\r\n") if x[:15].lower() == b"content-length:")
            end = head + 4 + length + 4
            if len(data) >= end:
                yield bytes(data[:end])
                del data[:end]
                continue
        if inflate.eof:
            # the next member; zeros between members are padding
            rest = inflate.unused_data.lstrip(b"\0")
            if not rest and at < len(content):
                rest, at = content[at : at + size].lstrip(b"\0"), at + size
            if rest:
                inflate = zlib.decompressobj(31)
                data += inflate.decompress(rest)
            elif at >= len(content):
                break
            continue
        if at >= len(content):
            break
        data += inflate.decompress(content[at : at + size])
        at += size
    if data or not inflate.eof:
        raise ValueError("archive ends inside a record")


def header_of(rec):
    head, _, block = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    return {k.decode(): v.decode() for k, v in fields.items()}, block[:-4]


def normalise(spark, source, target):
    """Rewrite every record of the archives in ``source`` as its own gzip member, with a sidecar index.

    Below ``target``, ``kind=warc/archive=N`` holds the archive and ``kind=cdx/archive=N`` its index: a line per record with record
    id, offset and length of the member. Both come from one pass, under Spark's commit protocol, so a lost task is done again
    whole. A task holds one archive. The only byte after the last member is a zero, which gzip readers take as padding.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                out, index, at = [], [], 0
                for rec in records_of(content):
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(rec) + z.flush()
                    index.append(f"{header_of(rec)[0]['WARC-Record-ID']} {at} {len(member)}")
                    out.append(member)
                    at += len(member)
                name = hashlib.blake2b(path.encode(), digest_size=8).hexdigest()
                yield pd.DataFrame({"kind": ["warc"], "archive": ["a" + name], "value": [b"".join(out)]})
                yield pd.DataFrame({"kind": ["cdx"], "archive": ["a" + name], "value": ["\n".join(index).encode()]})

    # archives stay bytes on their way through Python; as text they are written byte for byte
    done = files.mapInPandas(run, "kind string, archive string, value binary").withColumn("value", F.col("value").cast("string"))
    done.write.option("lineSep", "\0").partitionBy("kind", "archive").text(target)


def page_of(name):
    n = name[len("<urn:x-page:") : -1]
    return int(n) if n else None


def facts(rec):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, html of a record.

    Length and digest of a response are taken from its payload, those of a revisit, which has none, from its header.
    """
    head, block = header_of(rec)
    if head["WARC-Type"] == "revisit":
        return page_of(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], "revisit", page_of(head["WARC-Refers-To"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    return page_of(head["WARC-Record-ID"]), len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload.decode()


def read_back(spark, target):
    """The records of the normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to, html (null for
    revisits). Every archive is read member by member, by its own task; nothing is shuffled."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(target).where("kind = 'warc'").select("content")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]

    def run(batches):
        for b in batches:
            for content in b["content"]:
                for rows in chunks(map(facts, records_of(content)), 200):
                    f = pd.DataFrame(rows, columns=names)
                    yield f.assign(page_id=pd.array([r[0] for r in rows], dtype="Int64"), refers_to=pd.array([r[4] for r in rows], dtype="Int64"))

    return files.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def chunks(rows, n):
    rows = iter(rows)
    while part := list(islice(rows, n)):
        yield part


def read_index(spark, target):
    """The sidecar index: archive, record id, offset and length of each member."""
    lines = spark.read.option("lineSep", "\n").text(target).where("kind = 'cdx'")
    part = F.split(F.translate("value", "\0", ""), " ")
    return lines.where("length(value) > 1").select("archive", part[0].alias("record_id"), part[1].cast("long").alias("offset"), part[2].cast("long").alias("length"))


def round_trip(pages):
    """Write the archives of ``pages``, normalise them, read them back. Nulls and repeated rows: see ``assign_types``."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_monolithic(assign_types(pages), f"{folder}/whole")
    normalise(spark, f"{folder}/whole", f"{folder}/members")
    return read_back(spark, f"{folder}/members")


def op9_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).drop("html")
