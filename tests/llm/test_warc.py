"""Archives written, indexed, looked up and read back."""

import base64
import gzip
import hashlib
import os
import random
from collections import Counter

import pytest

from topicflow.llm import warc as W

SCHEMA = "page_id long, url string, html string, file string, first long"


def pages():
    r = random.Random(4)
    rows = [(i, f"http://{r.choice(['WWW.Example', 'a.b.example', 'x'])}.{r.choice(['com', 'org'])}/{r.choice('pqr')}{i % 9}?k=\u00e9", f"<p>{i % 60}</p>" * 9) for i in range(300)]
    rows += [(1000 + i, "http://one.example/hot", "same \u65e5\u672c") for i in range(150)]
    return rows + [(None, "http://n.example/", "null id"), (None, "http://n.example/", "null id"), (2000, None, "no url"), (2001, "", None), (2002, "no scheme", ""),
                   (2003, "http://c.example/a\r\nWARC-Type: x\t", "odd\r\n\r\nWARC/1.1"), (2004, "http://l.example/", "long " * 200_000),
                   (2005, "http://t.example/", "tie"), (2005, "http://t.example/", "tie"), (2005, "http://T.example/", "tie"), (None, "u://v", "<p>1</p>" * 9)]


def brute(rows, least):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    many = Counter(html or "" for _, _, html in rows)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = many[html or ""] > 1 and len(data) >= least and top.get(html or "") is not None and i != top[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[html or ""] if again else None))
    return out


@pytest.mark.parametrize("p", [W.Params(), W.Params(min_bytes=20, archive_bytes=3000, block_lines=5, gap=0, read_bytes=100)])
def test_rows(spark, p):
    rows = pages()
    df = spark.createDataFrame([(*x, "q", 3) for x in rows], SCHEMA).repartition(5)
    got = [tuple(x) for x in W.captures(df, p).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, p.min_bytes), key=repr)
    assert W.captures(df.limit(0)).count() == 0


def test_files_and_lookups(spark, tmpdir_path):
    rows = pages()
    df = spark.createDataFrame([(*x, "q", 3) for x in rows], SCHEMA).repartition(4)
    p = W.Params(block_lines=7, archive_bytes=20_000)
    a = W.archive(df, tmpdir_path + "/warc", p)
    names = os.listdir(tmpdir_path + "/warc")
    whole = b"".join(gzip.open(f"{tmpdir_path}/warc/{n}").read() for n in names if n.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    keys = [line for r in W._parts(a) for line in gzip.open(f"{tmpdir_path}/warc/{r['file']}").read().split(b"\n")[:-1]]
    firsts = [k.split(b"\t")[0] for k in keys]
    assert firsts == sorted(firsts) and len(keys) == len(rows) == a.manifest.agg({"lines": "sum"}).first()[0]
    for url in ("http://one.example/hot", "http://n.example/", "http://missing.example/", "http://l.example/"):
        found = W.lookup(spark, a, url)
        assert Counter(f["page_id"] for f in found) == Counter(i for i, u, _ in rows if u == url)
        assert all(f["payload"] is None or f["payload"] == next(h for i, u, h in rows if u == url and i == f["page_id"]).encode() for f in found)
    some = df.where("page_id % 50 = 0")
    got = W.fetch(a, W.locate(a, some.union(some)), p=p).collect()
    assert Counter(x["page_id"] for x in got) == Counter(i for i, _, _ in rows if i is not None and i % 50 == 0)


def test_lookup_opens_few_blocks(spark, tmpdir_path, monkeypatch):
    df = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 100, '.example/', id) as url", "cast(id as string) as html")
    a = W.archive(df, tmpdir_path + "/warc", W.Params(block_lines=20))
    reads = []
    read = W.Files.read
    monkeypatch.setattr(W.Files, "read", lambda self, *x: reads.append(x) or read(self, *x))
    assert [f["page_id"] for f in W.lookup(spark, a, "http://h7.example/1207")] == [1207]
    assert sum(n.endswith(".cdx.gz") for n, _, _ in reads) <= 2 and sum(n.endswith(".warc.gz") for n, _, _ in reads) == 1


def test_keys():
    assert W.surt("http://WWW.Example.com:80/A?b#c") == "com,example,www:80)/A?b#c"
    assert W.surt("https://example.org") == "org,example)" and W.surt(None) == "-" and W.surt("x") == "x)"
    assert W.surt("http://a.b/\n\tc") == "b,a)/%0A%09c"


def test_damaged_record_is_an_error():
    data = W.record(1, "u", b"abc", None, False)
    assert W.parse(data)["payload"] == b"abc"
    broken = gzip.compress(gzip.decompress(data).replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        W.parse(broken)
