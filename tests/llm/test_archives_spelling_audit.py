"""WARC archives, spelling variants and the filter audit against plain versions, with odd rows."""

import gzip
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import audit, spelling, warc

BIG = "<p>" + "é" * 600 + "</p>"  # over 1,000 bytes
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n\r\n\r\nWARC/1.\n" * 20


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1\r\nX: y", BIG, "x"), (5, "http://a/5", BIG, "x"), (3, None, BIG, "x"), (None, "u", BIG, "x"), (5, "again", BIG, None),
        (7, "", None, "x"), (8, "http://é/8", "", "x"), (9, "s", "small", "x"), (10, "s", "small", "x"), (11, "t", TRICKY, "x"), (12, "t", TRICKY, "x"),
        (None, "n", BIG + "n", "x"), (None, "n", BIG + "n", "x"), (20, "long", "0123456789" * 200_000 + "\U0001f600", "x"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def plain_records(rows):
    groups = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 1000 and r["page_id"] is not None:
            groups[body] = max(groups.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        to = groups.get(body)
        revisit = to is not None and r["page_id"] != to
        out.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 0])
def test_archives_round_trip(spark, pages, tmp_path, most):
    got = warc.through_archives(pages, f"file://{tmp_path}/w", most=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_records(pages.collect())


def test_every_record_is_a_member_of_its_own(spark, pages, tmp_path):
    warc.write(pages, f"file://{tmp_path}/raw")
    index = warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/out")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "raw").glob("*.gz")))
    rows = index.orderBy("file", "offset").collect()
    assert len(rows) == pages.count()
    seen = b""
    for r in rows:
        data = open(r["file"].removeprefix("file:"), "rb").read()
        unpack = zlib.decompressobj(wbits=31)
        record = unpack.decompress(data[r["offset"] : r["offset"] + r["length"]])
        assert unpack.eof and not unpack.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"WARC-Type: {r['record_type']}".encode() in record
        seen += record
    assert sorted(seen) == sorted(raw) and len(seen) == len(raw)
    for f in {r["file"] for r in rows}:  # other readers take the file as a whole
        assert len(gzip.decompress(open(f.removeprefix("file:"), "rb").read())) > 0
    one = warc.read(index.where("record_id = 20")).collect()
    assert [r["payload"].decode() for r in one] == [r["html"] for r in pages.where("page_id = 20").collect()]
    uris = {r["target_uri"] for r in warc.read(index, payload=False).collect()}
    assert "http://a/1%0D%0AX: y" in uris and None in uris and "http://é/8" in uris


def test_archives_of_no_pages_and_damaged_ones(spark, pages, tmp_path):
    assert warc.through_archives(pages.limit(0), f"file://{tmp_path}/none").collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(spark, f"file://{tmp_path}/bad", f"file://{tmp_path}/bad-out")


def test_cutter_takes_any_pieces():
    def record(n, body):
        return f"WARC/1.1\r\nWARC-Record-ID: {n}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    bodies = [b"", b"WARC/1.0", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 5000]
    stream = b"".join(record(i, b) for i, b in enumerate(bodies))
    for size in (1, 2, 7, 64, len(stream)):
        cutter = warc.Cutter()
        found = [r for a in range(0, len(stream), size) for _, r in cutter.feed(stream[a : a + size])]
        cutter.end()
        assert found == [record(i, b) for i, b in enumerate(bodies)]


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, letters, least, slips, factor):
    n = {}
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % slips == 0 else run
                n[word] = n.get(word, 0) + 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    out = {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        form = others[0] if others and n[others[0]] >= factor * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted((w, f, root(w), k, c, fn) for w, (f, k, c, fn) in out.items())


def as_rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants_against_brute_force(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(60):
        made = []
        for _ in range(120):
            w = list(random.choice(["Abcdefgh", "aaaaaaaa", "éàÿüößéa", "hellohello", "zzzzzzzzzzzz"], p=[0.6, 0.2, 0.1, 0.05, 0.05]))
            for _ in range(random.integers(0, 3)):
                k = int(random.integers(0, len(w)))
                w[k : k + 1] = [[], ["b"], [w[k], "a"], ["É"]][int(random.integers(0, 4))]
            made.append("".join(w))
        rows.append((i, random.choice([" ", ", ", "×1"]).join(made)))
    rows += [(None, rows[0][1]), (1, rows[1][1]), (70, None), (71, ""), (72, "q" * 30_000), (73, "q" * 30_000 + " " + "q" * 29_999), (74, "q" * 29_999)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, word string")
    for settings in ({"letters": 7, "least": 2, "slips": 31, "factor": 10}, {"letters": 5, "least": 1, "slips": 3, "factor": 2}):
        assert as_rows(spelling.variants(docs.repartition(3), **settings)) == plain_variants(rows, *settings.values())
    assert as_rows(spelling.variants(docs.limit(0))) == []


def test_deletion_keys_are_those_of_the_strings(words):
    texts = [*words[:50], "aaab", "é", "\U0001f600x", "b" * 4000]
    row, place, key, again = spelling.deletion_keys(texts)
    strings = [texts[r] if p < 0 else texts[r][:p] + texts[r][p + 1 :] for r, p in zip(row, place)]
    by_string, by_key = {}, {}
    for s, k in zip(strings, key.tolist()):
        assert by_string.setdefault(s, k) == k and by_key.setdefault(k, s) == s
    assert all((texts[r][p] == texts[r][p - 1]) == a for r, p, a in zip(row, place, again) if p > 0)


def test_colliding_keys_link_nothing():
    members = [(1, "abcd", 9, 1), (2, "axcd", 5, 1), (3, "zzzz", 100, 1)]
    assert sorted(spelling.partners(members, False)) == [(1, 1, 5, "axcd"), (2, 1, 9, "abcd")]
    members = [(1, "abc", 9, -1), (2, "abcd", 5, 3), (3, "zabc", 7, 0), (4, "qqqq", 100, 0)]
    assert sorted(spelling.partners(members, True)) == [(1, 2, 7, "zabc"), (2, 1, 9, "abc"), (3, 1, 9, "abc")]


def plain_audit(rows, good, toxic):
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    docs = []
    for d, text, source in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t],
        }
        docs.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        own, shapley, steps = [x for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                steps.append(
                    [part, "".join(order), k + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
                )
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_against_all_orders(spark):
    random = np.random.default_rng(8)
    texts = ["", None, "a b c", "A B C", "x " * 60, " ".join(map(str, range(60))), " ".join(f"W{i}" for i in range(60)) + " #", "\x1c word\x85" * 60, "y|" * 5000]
    rows = [(int(random.integers(0, 60)) if random.random() < 0.9 else None, texts[int(random.integers(0, len(texts)))], [None, "", "web", "é"][int(random.integers(0, 4))]) for _ in range(200)]
    labels = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 60, 2)] + [(2, 1, None), (4, None, 1), (None, 1, 1), (6, 7, -1), (1000, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, part int").repartition(4)
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    want = plain_audit(rows, {a for a, q, _ in labels if q == 1 and a is not None}, {a for a, _, t in labels if t == 1 and a is not None})
    got = audit.audit(docs, told)
    assert sorted(tuple(r) for r in got.collect()) == want and got.schema.simpleString() == audit.cells(docs, told).sparkSession.createDataFrame([], audit.SCHEMA).schema.simpleString()
    assert audit.audit(docs.limit(0), told).collect() == []
    none = audit.audit(docs, told.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in audit.swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))
