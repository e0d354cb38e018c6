"""Archives: lines of both versions, declared lengths, what is synthesised, revisits, and pages through all of it."""

import base64
import cProfile
import gzip
import hashlib
import itertools
import re
import uuid

import pytest

from parcelmint.llm import common, registry, warc

SF = "/root/testdata/sf0.001"
HTTP = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"


def arc(version, *docs, name="old.arc", date="19970912120000"):
    """An archive of (line but for its length, bytes)."""
    about = f"{version} 0 Someone\n{' '.join(warc.FIELDS[version])}\n".encode()
    more = "" if version == 1 else " 200 - - 0 old.arc"
    out = f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(about)}\n".encode() + about
    for line, data in docs:
        out += f"\n{line} {len(data)}\n".encode() + data
    return out + b"\n"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_versions_and_lengths():
    # a payload that looks like records, and one that is empty
    trap = HTTP + b"<p>\n\nhttp://b/ 1.2.3.4 19970101000000 text/html 5\nabcde\r\n\r\nWARC/1.1\r\n"
    one = list(warc.arc_records(arc(1, ("http://a/ 1.2.3.4 19970912121110 text/html", trap), ("dns:a 9.9.9.9 199709 text/dns", b"a 1.2.3.4\n"), ("http://c/ 0.0.0.0 19970912 text/html", HTTP))))
    assert [r["url"] for r in one] == ["filedesc://old.arc", "http://a/", "dns:a", "http://c/"] and [r["version"] for r in one] == [1] * 4
    assert one[1]["head"] == HTTP and one[1]["payload"] == trap[len(HTTP) :] and one[1]["date"] == "1997-09-12T12:11:10Z" and one[1]["status"] == 200
    # a date that is none is that of the archive; a short one is filled up
    assert one[2]["date"] == "1997-09-12T12:00:00Z" and one[3]["date"] == "1997-09-12T00:00:00Z"
    assert one[2]["head"] == b"" and one[2]["payload"] == b"a 1.2.3.4\n" and one[3]["payload"] == b"" and one[3]["payload_digest"] == sha(b"")
    two = list(warc.arc_records(arc(2, ("http://a/ 1.2.3.4 19990101000000 text/html 404 - - 300 old.arc", b"gone"))))
    assert two[1]["version"] == 2 and two[1]["status"] == 404 and two[1]["payload"] == b"gone" and not two[1]["truncated"]


def test_packed_and_damaged():
    whole = arc(1, ("http://a/ 1.2.3.4 19970912121110 text/html", HTTP + b"abc"))
    cut = whole.index(b"\nhttp://a/")
    for packed in (gzip.compress(whole), gzip.compress(whole[:cut]) + gzip.compress(whole[cut:])):
        assert [r["payload"] for r in warc.arc_records(packed)][1:] == [b"abc"]
    short = list(warc.arc_records(whole[:-3]))
    assert short[1]["truncated"] and short[1]["payload"] == b"a"
    for bad, says in ((b"hello\n", "filedesc"), (whole.replace(b"text/html", b"text/html 200"), "record 1"), (whole.replace(b"1 0 Someone", b"7 0 Someone"), "version")):
        with pytest.raises(ValueError, match=says):
            list(warc.arc_records(bad, "name"))
    assert list(warc.arc_records(b"")) == []


def test_dates():
    assert [warc.iso_date(x) for x in ("20010203040506", "2001020304", "20011301", "2001", "x", "")] == ["2001-02-03T04:05:06Z", "2001-02-03T04:00:00Z", None, None, None, None]


def test_years_of_three_digits():
    assert warc.iso_date("09990203") == "0999-02-03T00:00:00Z" and warc.iso_date("00000203") is None


def test_heads_and_digests():
    blocks = [b"HTTP/" + bytes(k) for n in range(7) for k in itertools.product(b"\r\na", repeat=n)]
    for block in [*blocks, b"HTTP", b"x\r\n\r\n", HTTP + b"\n\n", b"HTTP/1\n\r\n\n\r\n\r\n"]:
        ends = [m.end() for m in (re.search(b"\r\n\r\n", block), re.search(b"\n\n", block)) if m]
        assert warc.split_head(block) == (min([*ends, len(block)]) if block.startswith(b"HTTP/") else 0)
        for k in range(len(block) + 1):
            assert warc.base32_sha1(block[:k], block[k:]) == warc.base32_sha1(block) == sha(block)


def calls(run):
    """How many functions run() calls, built-in ones too."""
    profile = cProfile.Profile()
    profile.runcall(run)
    return sum(entry.callcount for entry in profile.getstats())


def test_work_of_a_record():
    # most pages are short, so what is done once a record is most of the work; the dates differ
    docs = [(f"http://a/{k} 1.2.3.4 {19970912000000 + k // 60 * 100 + k % 60} text/html", HTTP + b"<p>\n%d" % k) for k in range(600)]
    packed = gzip.compress(arc(1, *docs))
    found = []
    assert calls(lambda: found.extend(warc.arc_records(packed))) < 80 * len(docs) and [r["payload"] for r in found[1:]] == [d[len(HTTP) :] for _, d in docs]


def test_conversion(spark, tmp_path):
    body = b"\xff\xfe binary \x00\r\n\r\nWARC/1.1\r\n"
    one = arc(1, ("http://a/1 1.2.3.4 19970912121110 text/html", HTTP + body), ("http://a/2 1.2.3.4 19970913121110 text/html", HTTP + b"other"), ("dns:a 9.9.9.9 19970912 text/dns", body))
    two = arc(2, ("http://a/3 1.2.3.4 19990101000000 text/html 200 - - 300 old.arc", HTTP + body), ("http://a/4 - 19990101000000 no-type 200 - - 900 old.arc", HTTP + b"tail")[:2], name="new.arc")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(one)
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(two[:-4]))
    made = warc.convert(warc.read_arc(spark, str(tmp_path / "in")), warc.F.col("date"))
    again = {r.record_id for r in warc.convert(warc.read_arc(spark, str(tmp_path / "in")), warc.F.col("date")).collect()}
    warc.write_warc(made, str(tmp_path / "out"))
    raw = [r for p in sorted((tmp_path / "out").glob("part-*")) for r in warc.warc_records(p.read_bytes())]
    by = {r["fields"].get("warc-target-uri", r["fields"].get("warc-filename")): r for r in raw}
    kinds = {k: r["fields"]["warc-type"] for k, r in by.items()}
    assert kinds == {"old.arc": "warcinfo", "new.arc": "warcinfo", "http://a/1": "revisit", "http://a/2": "response", "dns:a": "resource", "http://a/3": "response", "http://a/4": "response"}
    # the latest capture is the response; the revisit keeps its head and points there
    first, last = by["http://a/1"], by["http://a/3"]
    assert first["fields"]["warc-refers-to"] == last["fields"]["warc-record-id"] and first["fields"]["warc-refers-to-target-uri"] == "http://a/3" and first["fields"]["warc-refers-to-date"] == "1999-01-01T00:00:00Z"
    assert first["head"] == HTTP and first["payload"] == b"" and first["fields"]["warc-payload-digest"] == "sha1:" + sha(body) and first["fields"]["warc-block-digest"] == "sha1:" + sha(HTTP)
    assert last["head"] + last["payload"] == HTTP + body and last["fields"]["warc-date"] == "1999-01-01T00:00:00Z" and last["fields"]["content-type"] == "application/http; msgtype=response"
    assert by["dns:a"]["payload"] == body and by["dns:a"]["fields"]["content-type"] == "text/dns" and "warc-ip-address" in by["dns:a"]["fields"]
    assert by["http://a/4"]["fields"]["warc-truncated"] == "unspecified" and "warc-ip-address" not in by["http://a/4"]["fields"]
    ids = [r["fields"]["warc-record-id"].strip("<>") for r in raw]
    assert len(set(ids)) == 7 and set(ids) == again and all(uuid.UUID(i).version == 5 and uuid.UUID(i).variant == uuid.RFC_4122 for i in ids)
    read = {r.url: r for r in warc.read_warc(spark, str(tmp_path / "out")).collect() if r.url}
    assert all(r.intact for r in read.values()) and bytes(read["http://a/3"].payload) == body and read["http://a/1"].payload is None


@pytest.mark.parametrize("version", [1, 2, None])
def test_pages_come_back(spark, tmp_path, version):
    long = "é€" * 700_000
    pages = [(1, "http://a/ b\n", "same"), (7, "http://b", "same"), (3, None, "same"), (4, "", None), (5, "u", ""), (6, "http://c", long), (6, "http://c", long), (None, "http://d", long), (None, None, "alone"), (8, "x", "HTTP/1.1 200 OK\r\n\r\nin it"), (-9, "y", "\n\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, path string, type int").repartition(3)
    out = warc.through_archives(df, "page_id", "url", "html", str(tmp_path / "x"), version).collect()
    assert len(out) == len(pages) and all(r.intact for r in out)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out)
    size = {t: (len(t.encode()), sha(t.encode())) for t in (p[2] or "" for p in pages)}
    want = [(False, 1, *size["same"], "revisit", 7), (False, 7, *size["same"], "response", 0), (False, 3, *size["same"], "revisit", 7), (False, 4, *size[""], "revisit", 5), (False, 5, *size[""], "response", 0)]
    want += [(False, 6, *size[long], "response", 0), (False, 6, *size[long], "revisit", 6), (True, 0, *size[long], "revisit", 6), (True, 0, *size["alone"], "response", 0)]
    want += [(False, 8, *size[pages[9][2]], "response", 0), (False, -9, *size[pages[10][2]], "response", 0)]
    assert got == sorted(want)
    assert {r.page_id: r.target_uri for r in out if r.page_id in (1, 3, 7)} == {1: "http://a/%20b%0A", 3: None, 7: "http://b"}


def test_least_bytes_and_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = [(f"http://a/{k} 1.2.3.4 1997091212111{k} text/html", HTTP + b) for k, b in enumerate((b"abc", b"abc", b"longer", b"longer"))]
    (tmp_path / "in" / "a.arc").write_bytes(arc(1, *docs))
    kinds = {r.url: r.type for r in warc.convert(warc.read_arc(spark, str(tmp_path / "in")), warc.F.col("date"), least_bytes=4).collect()}
    assert [kinds[f"http://a/{k}"] for k in range(4)] == ["response", "response", "revisit", "response"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.through_archives(empty, "page_id", "url", "html", str(tmp_path / "none")).collect() == []


def test_few_and_many_revisits(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for name in "ab":
        docs = [(f"http://{name}/{k} 1.2.3.4 199709121211{k:02d} text/html", HTTP + b"%d" % (k % 7)) for k in range(20)]
        (tmp_path / "in" / f"{name}.arc").write_bytes(arc(1, *docs, name=f"{name}.arc"))
    made, dealt = [], []
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for rows in (common.BROADCAST_ROWS, 25):
            monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
            found = warc.convert(warc.read_arc(spark, str(tmp_path / "in")), warc.F.col("date"))
            dealt.append("hashpartitioning(path" in found._jdf.queryExecution().executedPlan().toString())
            made.append(sorted((r.asDict() for r in found.collect()), key=lambda r: (r["path"], r["position"])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # 33 revisits: none of the payloads moves unless they are more than what may be broadcast
    assert dealt == [False, True] and made[0] == made[1] and sum(r["type"] == "revisit" for r in made[0]) == 33


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: r for r in registry.QUERIES["op12_warc"](spark, SF).collect()}
    assert len(found) == len(pages) and all(r.intact for r in found.values())
    first = {}
    for p in pages:
        first[p.html] = max(first.get(p.html, p.page_id), p.page_id)
    for p in pages:
        data, r = (p.html or "").encode(), found[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), sha(data)) and (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))
