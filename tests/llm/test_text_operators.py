"""BPE, chat, HTML and fingerprints on small rows, against libraries and plain versions."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import bpe, chat, fingerprints, html_extract

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t", "don't we'LL I'VE", "<|endoftext|>x<|startoftext|> <|endoftext|", "ΑΣ ΣΑΣ İstanbul ß", "á é fi ﬁ", "x\x1cy\x1dz\x85w\xa0q", "１２ ²³ ½",
    "日本語 한국어", "😀👍🏽", "hello!!!???...$$$", "aaaaaaaaaaaaaaaaaaaaaaaa hahahahaha", "word " * 30_000,
]


def test_bpe_equals_the_library(spark, words):
    random = np.random.default_rng(1)
    texts = ODD + [" ".join(random.choice(words, 50)) for _ in range(30)] + ["".join(random.choice(list("etaoin shrdlu'!9é"), 60)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, WORDS, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == decoded, text
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), WORDS).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", r"\<s> \\[INST]", "<<SYS>>\n[ROLE=x] y [/ROLE]", "[/INST] [inst] <s/> \\", ""]


@pytest.mark.parametrize("text", CONTROL)
def test_escapes_are_reversible_and_complete(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.escape(text) == text or chat.escape(text).count("\\") > text.count("\\")


def test_chat_reads_back(spark):
    turns = [(1, 0, "system", "be <s> kind"), (1, 1, "user", CONTROL[0]), (1, 2, "assistant", CONTROL[0]), (1, 3, "user", None), (1, 4, "assistant", "é😀 x")]
    turns += [(2, 0, "tool", CONTROL[2]), (2, 1, None, "a"), (2, 1, None, "a"), (3, None, "assistant", CONTROL[1]), (None, 0, "user", "u")]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(rows, BYTES).collect()}
    assert set(got) == {1, 2, 3, None}
    for key, row in got.items():
        own = sorted((t for t in turns if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    shown = chat.format_turns(rows, BYTES)
    parts = [r for r in shown.where("conv_id = 1").orderBy("turn").collect()]
    assert sum(len(r["formatted"]) for r in parts) == got[1]["formatted_chars"]
    assert all(len(r["ids"]) == len(r["loss_mask"]) for r in parts)
    assert [any(r["loss_mask"]) for r in parts] == [False, False, True, False, True]
    assert chat.read_back(rows.limit(0), BYTES).count() == 0


PAGES = {
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><!-- x --><div class='ad'>buy</div>"
    "<article><h1>Head &amp; line</h1><p><b>One<br> two.<p>Three &lt;b&gt;.</p><aside>side</aside></article><footer>foot</footer>": "Head & line\nOne two.\nThree <b>.",
    "<body><div id='cookie-notice'>cookies</div><div class=post><h2>T</h2><p>First, with some text; and more of it.</p><p>Second, again, with text. So it goes.</p><ul><li>item</li></ul>"
    "<form><p>name</p></form></div><section class='comments'><p>A long comment, with text; by a reader, who writes.</p></section></body>": "T\nFirst, with some text; and more of it.\nSecond, again, with text. So it goes.\nitem",
    "": "",
    None: "",
    "<script>only()</script>": "",
    "plain   words\n here": "plain words here",
    "<p>cut &am": "cut &am",
}


def test_main_text(spark):
    rows = spark.createDataFrame([(i, None, h, 0) for i, h in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract(rows).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    deep = "<div>" * 3000 + "<p>deep, text</p>" + "</div>" * 3000
    assert html_extract.main_text(deep) == "deep, text"


LONG = ["First, a paragraph of some length; it has commas, full stops, and more. Then it goes on, as text does.", "Another one, with clauses; longer than a card, by far. It ends here, at last, with a stop."]


def test_main_text_articles_only_weigh_in():
    cards = "".join(f"<article><h3>Card {i}</h3><p>Short teaser {i}</p></article>" for i in range(6))
    body = "".join(f"<p>{t}</p>" for t in LONG)
    assert html_extract.main_text(f"<body><div>{body}</div><div><div>{cards}</div></div></body>") == "\n".join(LONG)
    assert html_extract.main_text(f"<div>{body}</div><div><article><p>One card</p></article></div>") == "\n".join(LONG)
    links = "".join(f"<li><a href='/{i}'>A linked headline of another page, number {i}</a></li>" for i in range(5))
    page = f"<article><h1><a href='/'>Title</a></h1>{body}<ul><li>item</li></ul><ul>{links}</ul><div><p>Buy now</p></div></article><div><p>Out there.</p></div>"
    assert html_extract.main_text(page) == "\n".join(["Title", *LONG, "item"])


def test_main_text_names_only_speak_against_a_part():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    whole = "\n".join(LONG)
    for name in ("content no-sidebar", "has-sidebar", "header-fixed", "sidebar"):
        assert html_extract.main_text(f"<body><nav>menu</nav><div class='{name}'>{body}</div></body>") == whole
        assert html_extract.main_text(f"<div class='{name}'><article>{body}</article></div><div class='sidebar'><p>A side note, as it is.</p></div>") == whole
    assert html_extract.main_text(f"<form id=aspnet><article>{body}</article><p>name</p></form>") == whole
    inner = f"<section id='related-work'><h2 id='social-structure'>Social</h2>{body}</section><section id='search-algorithms'>{body}</section>"
    assert html_extract.main_text(f"<article><div class='post-header'><h1>T</h1></div>{inner}</article>") == f"T\nSocial\n{whole}\n{whole}"
    comments = "<div class='comments'>" + body.replace("paragraph", "comment") * 5 + "</div>"
    assert html_extract.main_text(f"<article>{body}</article>{comments}") == whole


def test_main_text_drops_only_script_and_style():
    assert html_extract.main_text("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, and <object>that</object>.</p><noscript><p>No script, here.</p></noscript>") == "So x=1, and that.\nNo script, here."
    for tag in ("math", "object", "noscript", "svg", "select", "iframe"):
        assert LONG[0] in html_extract.main_text(f"<p>Some text, here.</p><{tag}><p>{LONG[0]}</p>")
    assert html_extract.main_text("<p>Some text.</p><script>var a = '<p>b</p>'") == "Some text."


def test_main_text_one_huge_path_hides_no_other():
    huge = "Fifty characters of text, with a mark or two. So, " * 20_000
    ordinary = [f"Paragraph {i}: " + "Fifty characters of text, with a mark or two. So, " * 10 for i in range(30)]
    want = [" ".join(t.split()) for t in [huge, *ordinary]]
    for one, many in (("<div><pre>{}</pre></div>", "<section><div><p>{}</p></div></section>"), ("<section><div>{}</div></section>", "<div>{}</div>"), ("<p>{}</p>", "<div><div>{}</div></div>")):
        page = "<nav><ul><li>menu</li></ul></nav>" + one.format(huge) + "".join(many.format(t) for t in ordinary) + "<div><div><div>Buy now</div></div></div>"
        assert html_extract.main_text(page) == "\n".join(want)
        assert html_extract.main_text(f"<article>{page}</article>") == "\n".join(want)


def test_main_text_reads_quotes_as_html_does():
    assert html_extract.main_text("<p title=it's>One, two.</p><p>Three, it's four.</p><p>Five.</p>") == "One, two.\nThree, it's four.\nFive."
    assert html_extract.main_text("<p title='a > b' class=\"x'>y\">One, two.</p><p data-x = 'it\"s'>Three.</p>") == "One, two.\nThree."
    page = "<article><div class='article-header'><h1>T</h1></div>" + "".join(f"<p>{t}</p>" for t in LONG) + "<p class='search-results'>Found, at last.</p></article>"
    assert html_extract.main_text(page) == "\n".join(["T", *LONG, "Found, at last."])
    assert html_extract.main_text("<div " + "a='" * 50_000 + ">x</div><p>End, here.</p>") is not None


def test_main_text_of_long_pages_and_repeated_rows(spark):
    body = "".join(f"<p>{t} {i}</p>" for i, t in enumerate(LONG * 5_000))
    rows = spark.createDataFrame([(1, "u", f"<nav>menu</nav><div>{body}</div><div><div><p>Buy now</p></div></div>", "x")] * 2, "page_id long, url string, html string, text string")
    got = html_extract.extract(rows).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_chars"] == sum(len(t) + len(str(i)) + 2 for i, t in enumerate(LONG * 5_000)) - 1
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_long_words_are_merged_as_the_library_does():
    random = np.random.default_rng(12)
    words = ["".join(random.choice(list("etaoinshrdlu"), n)) for n in (65, 300, 20_000)] + ["a" * 5_001, "ha" * 3_000 + "h", "日本" * 500]
    vocabulary, tokenizer = bpe.Vocabulary(WORDS), Tokenizer.from_file(WORDS)
    for word, (ids, _) in zip(words, vocabulary.encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids
    assert vocabulary.merge_all([vocabulary.letters("aaaaaaa" + bpe.END)]) == [vocabulary.merge_long(vocabulary.letters("aaaaaaa" + bpe.END))]


def test_words_are_forgotten_by_bytes(monkeypatch):
    vocabulary = bpe.Vocabulary(WORDS)
    monkeypatch.setattr(bpe, "REMEMBERED", 1_000)
    first = list(vocabulary.encode(["one two three four five <|endoftext|>"]))
    for _ in range(3):
        list(vocabulary.encode([f"word{i} other" for i in range(20)]))
        assert list(vocabulary.encode(["one two three four five <|endoftext|>"])) == first
    assert len(vocabulary.known) < 60


def plain_likeness(a, b):
    """Two fingerprints' likeness, bin by bin."""
    cells = [[(int(s[i : i + 4], 16), int(s[i + 4 : i + 12], 16)) for i in range(0, len(s), 12)] for s in (a, b)]
    empty = (0xFFFF, 0xFFFFFFFF)
    shifts = [y[1] - x[1] for x, y in zip(*cells) if x != empty and y != empty and x[0] == y[0]]
    filled = sum(x != empty or y != empty for x, y in zip(*cells))
    typical = sorted(shifts)[(len(shifts) - 1) // 2] if shifts else 0
    return sum(abs(s - typical) <= fingerprints.SLACK for s in shifts) / filled if filled else 1.0


def plain_fingerprint(text):
    """Each bin's anchor of smallest (rank, tag), first place, written as hex digits."""
    data, best = (text or "").encode(), {}
    if 0 < len(data) < fingerprints.K:
        found = [(0, int.from_bytes(hashlib.sha256(data).digest()[:8], "little"))]
    else:
        halves = [np.array([int.from_bytes(data[i + o : i + o + 8], "big")], dtype=np.uint64) for i in plain_syncmers(text or "") for o in (0, 8)]
        found = [(i, int(fingerprints._mix(a * np.uint64(0x9E3779B97F4A7C15) ^ fingerprints._mix(b))[0])) for i, a, b in zip(plain_syncmers(text or ""), halves[::2], halves[1::2])]
    for place, anchor in found:
        own = (anchor & 0xFFFF, anchor >> 41 & 0xFFFF, place)
        best[anchor >> 57] = min(best.get(anchor >> 57, own), own)
    return "".join(f"{best[b][1]:04x}{best[b][2]:08x}" if b in best else "f" * 12 for b in range(fingerprints.BINS))


def plain_syncmers(text):
    """Anchors of a text, one by one."""
    data = np.frombuffer(text.encode(), np.uint8)
    k, s = fingerprints.K, fingerprints.S
    out = []
    for i in range(len(data) - k + 1):
        own = fingerprints._mix(np.array([int.from_bytes(data[i + j : i + j + s].tobytes(), "big") for j in range(k - s + 1)], dtype=np.uint64))
        if own.min() in (own[0], own[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(words):
    text = " ".join(words[:40])
    data = np.frombuffer(text.encode(), np.uint8)
    low = fingerprints._smallest(fingerprints._mix(fingerprints._packed(data, 8)), 9)
    mers = fingerprints._mix(fingerprints._packed(data, 8))
    found = np.flatnonzero((low == mers[: len(low)]) | (low == mers[8 : 8 + len(low)]))
    assert found.tolist() == plain_syncmers(text)


def test_fingerprints_follow_edits(spark, words):
    random = np.random.default_rng(2)
    texts = [" ".join(random.choice(words, n)) for n in (300, 200, 400, 1, 3)] + [None, "", "é😀" * 40]
    docs = spark.createDataFrame([(i * 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in fingerprints.against_next(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        half = len(text) // 2
        row = got[i * 7]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert 0.15 < got[0]["near_edited"] < 0.6 and got[14]["near_next"] < 0.05
    assert got[35]["fingerprint"] == got[42]["fingerprint"]
    lone = fingerprints.against_next(docs.where("doc_id = 7")).collect()[0]
    assert lone["near_next"] == 1
    twice = docs.where("doc_id < 15").union(docs.where("doc_id = 7")).union(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert fingerprints.against_next(twice).count() == 5
    assert fingerprints.against_next(docs.limit(0)).count() == 0
    assert {r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()} == {r["fingerprint"] for r in got.values()}


def test_fingerprints_and_likeness_equal_plain_ones(spark, words):
    random = np.random.default_rng(13)
    texts = [" ".join(random.choice(words, n)) for n in (60, 40, 80, 1, 2)] + [None, "", "é😀" * 20, "x" * 15]
    texts.append(texts[0])
    rows = [(i // 2 * 3, t) for i, t in enumerate(texts)] + [(None, texts[1])]  # ids come twice
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    ids = sorted({i for i, _ in rows if i is not None})
    least = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    want = []
    for i, t in rows:
        t, after = t or "", "" if i is None else least[ids[ids.index(i) - 1]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, beyond = map(plain_fingerprint, (t, edited, after))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, round(plain_likeness(own, changed), 9), round(plain_likeness(own, beyond), 9)))
    got = [(str(r["doc_id"]), *r[1:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.against_next(docs).collect()]
    assert sorted(got) == sorted(want)


def test_positions_have_room_for_any_text():
    data = np.frombuffer(b"lead " * 3_600_000 + b"the very last words of a long text, which stand far out", np.uint8)  # beyond 2^24 bytes
    cells = fingerprints.sketch(data, np.array([0, len(data)]))
    places = cells[cells != fingerprints._EMPTY] & np.uint64((1 << fingerprints.POSITION_BITS) - 1)
    assert places.max() > 1 << 24


def test_many_ranges_give_the_same_chain(spark, words, monkeypatch):
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(words, 5)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    one = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.against_next(docs).collect()}
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.against_next(docs).collect()} == one


def test_turns_are_encoded_as_the_library_does():
    codec = chat.Codec(BYTES)
    assert codec.by_word and codec.bytes
    rng, letters = random.Random(3), "a b'sS\t\n\r\x0b\x1c\x1f\x85\xa0\u3000\u2028é中😀1²½_-!' 'll've<|endoftext|>\ufeff\u0301٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 15))) for _ in range(3000)] + ["", "x" * 3000, " " * 50, "<|endoftext|>"]
    ids = codec.encode(texts)
    assert ids == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert codec.decode(ids) == texts
    broken = [[rng.randrange(codec.first - 1) for _ in range(rng.randint(0, 6))] for _ in range(2000)]
    assert codec.decode(broken) == codec.tokenizer.decode_batch(broken, skip_special_tokens=False)


def test_main_text_of_deep_pages_takes_linear_time():
    for unit in ("<div>x", "<div class=ad>x", "<p>a<li>b<div>", "<article>z, y.", "<!-- ", "<a x=\""):
        took = []
        for k in (5_000, 40_000):
            began = time.process_time()
            html_extract.main_text(unit * k)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.05), unit  # eight times as much; 64 times if quadratic


def test_main_text_reads_empty_comments_as_html_does():
    for comment in ("<!-->", "<!--->", "<!---->", "<!-- a -->", "<!--a--!>"):
        assert html_extract.main_text(f"{comment}<p>After, the text.</p>") == "After, the text."


def test_main_text_takes_articles_in_an_article_for_comments():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    remarks = "".join(f"<article><p>I think, as a reader, that this is right; number {i}, so to say.</p></article>" for i in range(2))
    assert html_extract.main_text(f"<article><h1>T</h1>{body}<section id=x>{remarks}</section></article>") == "\n".join(["T", *LONG])
    assert html_extract.main_text(f"<article><h1>T</h1>{body}<div id='discussion'><p>A reader's remark, with a comma.</p></div></article>") == "\n".join(["T", *LONG])
    assert "\n".join(LONG) in html_extract.main_text(f"<article><h1>T</h1><article>{body}</article></article>")  # most of the text


def plain_content_paths(blocks, main):
    """The ratios path by path, paths as tuples of tags."""
    paths = sorted({(p, a) for p, _, a, _ in blocks})
    own = {k: [b for b in blocks if (b[0], b[2]) == k] for k in paths}
    size = {k: sum(len(t) * (1 - x) for _, t, _, x in own[k]) for k in paths}
    marks = {k: 1 + sum(len(html_extract.PUNCTUATION.findall(t)) * (1 - x) for _, t, _, x in own[k]) for k in paths}
    fused = {}
    lengths = {k: size[k] / (size[k] + html_extract.PARAGRAPH * len(own[k])) for k in paths}
    stops = {k: marks[k] / (marks[k] + html_extract.STOPS * len(own[k])) for k in paths}
    trusted = {k: size[k] * html_extract.MARKED ** k[1] for k in paths}
    inside = {k: bool(main & set(k[0])) for k in paths}
    share = sum(trusted[k] for k in paths if inside[k]) / sum(trusted.values())
    for k in paths:
        fused[k] = html_extract.MARKED ** k[1] * (html_extract.PRIOR + (share if inside[k] else 1 - share))
        for values in (lengths, stops):
            beside = [o for o in paths if o[0][:-1] == k[0][:-1] and o[1] == k[1]]
            fused[k] *= (values[k] + sum(values[o] * len(own[o]) for o in beside) / sum(len(own[o]) for o in beside)) / 2
    mean = sum(fused.values()) / len(fused)
    spread = (sum((f - mean) ** 2 for f in fused.values()) / len(fused)) ** 0.5
    return {k for k, f in fused.items() if f >= html_extract.SHARE * spread and f >= html_extract.LEAST * max(fused.values())}


def test_path_ratios_against_a_plain_version():
    random = np.random.default_rng(11)
    for _ in range(200):
        tags = ["div", "p", "article", "li", "section"]
        paths = [tuple(random.choice(tags, random.integers(0, 5))) for _ in range(8)]
        blocks = [(paths[random.integers(0, 8)], "word, " * int(random.integers(1, 40)), float(random.choice([0.0, 0.5, 1.0])), float(random.choice([0.0, 0.3]))) for _ in range(20)]
        number, parent, main = {(): 0}, [0], [False]
        for p in paths:
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(parent)
                    parent.append(number[p[: k - 1]])
                    main.append("article" in p[:k])
        got = html_extract.content_paths([(number[p], t, a, x) for p, t, a, x in blocks], parent, main)
        names = {v: k for k, v in number.items()}
        assert {(names[p], a) for p, a in got} == plain_content_paths(blocks, {"article", "main"})
