import hashlib
import random

from pyspark.sql import functions as F

from loomgraph.llm import fixity

SCHEMA = "number long, url string, body string"


def record():
    return fixity.warc_record(F.col("number"), F.col("url"), F.col("body"))


def brute(rows):
    files, out = {}, {}
    for n, url, body in rows:
        n, body = -1 if n is None else n, body or ""
        data = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nWARC-Record-ID: <urn:record:{n}>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()
        files.setdefault(n // 4096, {}).setdefault(n, []).append(data)
    for f, records in files.items():
        at = 0
        for n in sorted(records):
            size, digests = sum(map(len, records[n])), sorted(hashlib.sha256(x).hexdigest() for x in records[n])
            out[n] = (f, at, at + size, digests[0] if len(digests) == 1 else hashlib.sha256(",".join(map(str, [len(digests), *(sum(int(h[i : i + 15], 16) for h in digests) for i in range(0, 60, 15))])).encode()).hexdigest())
            at += size
    return out


def test_equals_comparing_everything(spark):
    r = random.Random(3)
    first = [(i * 7, f"http://{i}", "é" * r.randrange(50)) for i in range(3000)] + [(None, None, None), (21, "twice", "x"), (90_000, "long", "z" * 300_000)]
    second = []
    for n, u, b in first:
        x = r.random()
        if x < 0.01:
            continue
        second.append((n, u, (b or "") + "!" if x < 0.02 else b))
    second += [(5, "new", "y"), (70_001, "new", "y")]
    a, b = brute(first), brute(second)
    # lengths count, places don't: what only moved is intact
    key = lambda v: v and (v[2] - v[1], v[3])
    want = {n: (a.get(n), b.get(n)) for n in a.keys() | b.keys() if key(a.get(n)) != key(b.get(n))}
    frames = [spark.createDataFrame(x, SCHEMA).withColumn("hash", F.lit(1)).withColumn("file", F.lit(2)) for x in (first, second)]
    got = fixity.audit(*frames, "number", record()).collect()
    assert {x["number"]: ((x["file"], x["begin_a"], x["end_a"], x["sha256_a"]) if x["sha256_a"] else None, (x["file"], x["begin_b"], x["end_b"], x["sha256_b"]) if x["sha256_b"] else None) for x in got} == want
    assert len(got) == len(want) and {x["status"] for x in got} == {"missing", "extra", "changed"}


def test_equal_and_empty_replicas(spark):
    some = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (5000, None, "")], SCHEMA)
    assert fixity.audit(some, some, "number", record()).collect() == []
    assert fixity.audit(some.limit(0), some.limit(0), "number", record()).collect() == []
    assert {x["status"] for x in fixity.audit(some, some.limit(0), "number", record()).collect()} == {"missing"}
