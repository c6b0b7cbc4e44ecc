"""Small cases of every operator against brute force: nulls, empty texts, ties, repeats, empty tables, clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keelson.llm import bpe, chat, fingerprint, html, jaccard, packing, pii, toxicity, vectors, warc

DOCS = "doc_id long, text string, n long, piece string"  # names that operators use themselves
WORD = public_tokenizers.path("word_bpe_49k.json")


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], DOCS)


def _shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_jaccard_equals_brute_force(spark):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(3, 40))] for _ in range(8)]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO")]
    for k in range(60):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 60)}"
        texts.append((5 + k, " ".join(words)))
    texts.append(texts[-1])
    sets = {i: _shingles(t) for i, t in texts}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.jaccard_components(_docs(spark, [*texts, (None, "a b c d e f")])).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.n_shingles == 2
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), root[row.doc_id]), row


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_components(_docs(spark, [])).count() == 0


def test_trie_overlaps():
    r = np.random.default_rng(1)
    pivot = np.unique(r.integers(0, 3000, 900)).astype(np.uint64)
    sets = [np.unique(np.r_[r.choice(pivot, 700), r.integers(0, 3000, k)]).astype(np.uint64) for k in (0, 5, 50, 400, 2000)] + [pivot]
    for s, o in zip(sets, jaccard.trie_overlaps(pivot, sets, 75), strict=True):
        true = len(np.intersect1d(s, pivot))
        assert o == (true if true >= jaccard.needed(len(s), len(pivot), 75) else -1)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 700, 12_000):
        base = rng.integers(0, 1 << 63, n * 2, np.int64).astype(np.uint64)
        sets = sorted((np.unique(rng.choice(base, n)) for _ in range(8)), key=len)
        maps = jaccard._bitmaps([jaccard.parity(s) for s in sets])
        for i, s in enumerate(sets):
            start, rows = maps[len(jaccard.parity(s))]
            for j in range(i + 1, len(sets)):
                differ = int(np.bitwise_count(rows[j - start] ^ rows[i - start]).sum())
                true = len(np.setxor1d(s, sets[j]))
                assert differ <= true and (true - differ) % 2 == 0
                if n == 700:
                    assert differ > true // 2


def test_jaccard_of_a_passage_that_many_share(spark):
    rng, passage = random.Random(3), " ".join(f"p{k}" for k in range(30))
    texts = [f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20 + k % 30)) for k in range(60)]
    texts += [f"{t} more" for t in texts[::3]]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(_docs(spark, list(enumerate(texts)))).collect()}
    sets = [_shingles(t) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    want[j] = want[i] = min(want[i], want[j])
        if want == (again := list(want)):
            break
    assert [got[k] for k in range(len(texts))] == again


def test_packing_is_whole_and_tight(spark):
    texts = [(1, None), (2, ""), (3, "hello " * 5000), (4, "Foo, bar! don't"), (4, "Foo, bar! don't"), (None, "x"), *((10 + k, "word " * k) for k in range(60))]
    rows = packing.pack_documents(_docs(spark, texts), WORD, capacity=64).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4").tobytes()
            want[(i, k // 64, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    gaps = []
    for length in sorted((r.length for r in rows), reverse=True):  # best-fit decreasing, one by one
        fit = min((k for k, g in enumerate(gaps) if g >= length), key=lambda k: gaps[k], default=None)
        if fit is None:
            gaps.append(64 - length)
        else:
            gaps[fit] -= length
    assert len(by) == len(gaps)
    assert packing.pack_documents(_docs(spark, []), WORD).count() == 0


def test_chat_round_trip_and_rewriting(spark):
    rows = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "a\\n<|\\|<\\|\n"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "a\nb", "x"), (1, 1, "assistant", "a\\n<|\\|<\\|\n")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 2, None: 1}
    loss = "a\\n<|\\|<\\|\n" * 2
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    counting = chat.format_conversations(table, lambda turns: f"[{len(turns)}]" + chat.chatml(turns))
    assert all(r.rewritten for r in counting.collect())
    turns = [("user", "x" * (k % 7)) for k in range(200)]
    out, places = chat.render(turns)
    assert out == chat.chatml(turns) and all(out[p[2] : p[3]] == t for (_, t), p in zip(turns, places, strict=True))
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_finds_rewriting_in_long_conversations(spark):
    forgets = lambda turns: chat.chatml(turns if len(turns) <= 100 else turns[1:])
    counts = lambda turns: "".join(f"{k}:{chat.chatml([t])}" for k, t in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(150)]
    table = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(table, forgets).first().rewritten
    got = chat.format_conversations(table, counts).first()
    assert (got.formatted, got.rewritten) == (counts(turns), False)
    assert all(got.formatted[p.text_start : p.text_end] == t for (_, t), p in zip(turns, got.turns, strict=True))


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(40)] = r.choice(["grubble", "snarkly"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = _docs(spark, [*rows, (9000, None), (None, "")])
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (y == 1) for i, y in held) >= 0.97 * len(held)
    assert got[9000] < 0.5 and len(got) == 602


def test_fingerprints(spark):
    texts = [(2, "a b\nc d\n\nx"), (1, "c d\nx\na b\n"), (3, None), (4, "one. two three\nfour " * 30), (4, "zz"), (None, "q")]
    got = fingerprint.edited_documents(_docs(spark, texts)).collect()
    order = sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))
    edited = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        edited[(i, len(t), hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited
    prints = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert prints[(1, 10)] == spark.range(1).select(fingerprint.text_form(fingerprint.fingerprint(F.lit("a b\nx\nc d\n")))).first()[0]
    parts = spark.range(1).select(fingerprint.fingerprint(F.lit("p. q\nr")).alias("a"), fingerprint.fingerprint(F.lit("s\nt ")).alias("b"), fingerprint.fingerprint(F.lit("p. q\nr\ns\nt ")).alias("c"))
    assert parts.select(fingerprint.combine(F.col("a"), F.col("b")) == F.col("c"), fingerprint.combine(F.col("c"), F.col("b"), -1) == F.col("a")).first() == (True, True)
    assert fingerprint.edited_documents(_docs(spark, [])).count() == 0


def test_likeness_follows_the_true_cosine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400").orderBy("doc_id")
    texts = [r.text for r in docs.select("text").collect()]
    phrase = re.compile(r"\n|(?<=[\W_aest])[^\S\n]+")
    r, pairs, true = random.Random(8), [], []
    for k, t in enumerate(texts):
        cut = len(t) * r.randint(0, 3) // 4
        pairs.append((k, t, t[:cut] + texts[(k + 1) % len(texts)][cut:]))
        a, b = (Counter(phrase.split(x)) for x in pairs[-1][1:])
        dot = sum(n * b[w] for w, n in a.items())
        true.append(dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5)
    fp = lambda c: fingerprint.fingerprint(F.col(c))
    table = spark.createDataFrame(pairs, "k int, a string, b string").repartition(4)
    got = {x.k: x.l for x in table.select("k", fingerprint.likeness(fp("a"), fp("b")).alias("l")).collect()}
    off = [abs(got[k] - t) for k, t in enumerate(true)]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.05


def test_warc_round_trip(spark):
    rows = [(1, "u", "a" * 100000), (2, "u2", "a" * 100000), (3, None, None), (4, "x", ""), (5, "é", "é😀" * 9000), (6, "z\r\nX: y", "0\r\n\r\n"), (7, "k", "y" * 50000), (7, "k", "y" * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.archive_round_trip(pages).collect() if r.page_id)
    first = {}
    want = []
    for i, _, text in rows:
        data = (text or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        f = first.setdefault(digest, i)
        want.append((i, len(data), digest, "response" if f == i else "revisit", None if f == i else f))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    assert warc.unchunked(warc.chunked(b"x" * 20000)) == b"x" * 20000
    with pytest.raises(warc.BadArchive):
        warc.reassemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(warc.BadArchive):
        warc.reassemble([(1, None, b"a"), (2, 3, b"b")])


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(20, 16))
    x = [base[k % 20] + r.normal(size=16) * 0.1 for k in range(200)]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, rows[0][1]), (305, [2 * c for c in rows[0][1]]), (306, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q.vec_id: q for q in vectors.near_duplicates(table).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 300 or i in (304, 305)}
    for i, u in unit.items():
        assert got[i].n_links == sum(j != i and float(u @ w) >= 0.95 for j, w in unit.items()), i
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 306))
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_vector_links_of_a_large_group_are_whole(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=32) + r.normal(size=(4000, 32)) * 0.17
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q.vec_id: q.n_links for q in vectors.near_duplicates(table, passes=6, window=16).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert all(got[k] == want[k] for k in range(4000))


def test_vector_borders_reach_over_short_ranges():
    ends = [(t, side, 5, (2, 0), (2, 0)) for t in range(4) for side in (0, 1)]
    got = set(vectors._reached(ends, 8))
    assert {(t, 0, b) for t in range(4) for b in range(max(0, t - 2), t)} == {g for g in got if g[1] == 0}


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.Codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(1)
    parts = ["a", "ab", "the ", "é", "漢", "😀", " ", "\n", "  ", "1", "!!", "'s", "<|endoftext|>", "x" * 50, "=" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 200))) for _ in range(100)] + ["a" * 5000, "=-" * 2000, " " * 3000, "hello  \n world  " * 9000]
    for data in (b"a" * 700, b"=-" * 400, bytes(r.randrange(97, 100) for _ in range(900)), bytes(r.randrange(256) for _ in range(900))):
        assert own.merge(data) == own.encode_match(data) == library._core_bpe.encode_single_piece(data)
    for t in [*texts, "ab" * 100_000, "x" * 100_001]:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    row = bpe.round_trip(_docs(spark, [(1, None)]), path, public_tokenizers.PATTERN).first()
    assert (row.n_tokens, row.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_html(spark):
    page = (
        '<html><body><header>H <h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><article><h1>T &amp; t</h1><p>x <b>y</b>&nbsp;\n z<p>two<div class="ad-box">AD</div>'
        '<form><p>f</p></form><section id="comments"><p>c</p></section><script>var t="</p>";</script></article><aside><p>s</aside><footer>f'
    )
    assert html.main_texts([page, "", "<p>a < b &lt; c</p>"]) == ["T & t\nx y z\ntwo", "", "a < b < c"]
    shared = "<p>home about contact imprint terms privacy help shop</p>"
    plain = [f"{shared}<p>text number {k} says {k * 7} things</p>" for k in range(5)]
    assert html.main_texts(plain) == [f"text number {k} says {k * 7} things" for k in range(5)]
    pages = spark.createDataFrame([(1, "http://h/x", page), (2, None, None), (None, "http://h/y", page)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got == {1: ("T & t\nx y z\ntwo", 15), 2: ("", 0), None: ("T & t\nx y z\ntwo", 15)}


def test_html_of_inline_templates_and_unclosed_raw_elements():
    page = '<article><span class="share">Share<span>x</span>y</span><p>A</p><p>B <b>c</b> d</p></article>'
    assert html.main_texts([page]) == ["A\nB c d"]
    assert html.main_texts(['<article><p>x <a class="share">t</a> y</p></article>']) == ["x\ny"]
    assert html.main_texts(["<html><head><title>T</title><meta a=b><body><p>text</p>", "<head><title>T<p>text</p>", "<p>a<svg><path d=x></p><p>b</p>"]) == ["text", "text", "a\nb"]


def _brute_texts(pages):
    """Each block's kind by structure, then the distinct pages of every run of 8 words of one kind, by dictionaries."""

    def kind(b, best):
        if b.template or b.main < best or (b.doubtful and not best):
            return None
        return "loose" if b.doubtful or not best else "framed"

    kinds = [[kind(b, max((x.main for x in page if not x.template), default=0)) for b in page] for page in pages]
    words = [{k: [w for b, own in zip(page, of) if own == k for w in b.text.lower().split()] for k in ("loose", "framed")} for page, of in zip(pages, kinds)]
    owners = {}
    for n, page in enumerate(words):
        for k, own in page.items():
            for i in range(len(own) - 7):
                owners.setdefault((k, tuple(own[i : i + 8])), set()).add(n)
    out = []
    for page, of, all_words in zip(pages, kinds, words):
        hidden = {k: np.zeros(len(own), bool) for k, own in all_words.items()}
        for k, own in all_words.items():
            for i in range(len(own) - 7):
                if len(owners[(k, tuple(own[i : i + 8]))]) >= (3 if k == "loose" else max(3, len(pages) / 2)):
                    hidden[k][i : i + 8] = True
        at, kept = {"loose": 0, "framed": 0}, []
        for b, k in zip(page, of):
            if k:
                n = len(b.text.split())
                if hidden[k][at[k] : at[k] + n].mean() < 0.8:
                    kept.append(b.text)
                at[k] += n
        out.append("\n".join(kept))
    return out


def test_html_equals_brute_force_whatever_the_groups(spark):
    r = random.Random(6)
    line = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    notes, titles = [line(12) for _ in range(3)], [line(9) for _ in range(4)]
    pages = []
    for k in range(60):
        inner = f"<h1>{r.choice(titles)}</h1><p>{line(r.randint(1, 30))}</p><p>{notes[0]}</p><div class=related>{r.choice(notes)}</div><div class=banner>{line(9)}</div>"
        body = f"<article>{inner}</article>" if k % 9 else inner
        pages.append(f"<nav>{line(4)}</nav>{body}<p>{notes[1]}</p>")
    pages += [pages[0]] * 4 + ["", "<p>Not Found</p>"]
    want = _brute_texts([html.blocks_of(p) for p in pages])
    assert html.main_texts(pages) == want
    assert "\n".join(want).count(notes[0]) == 0 and any(t in "\n".join(want) for t in titles)
    rows = [(k, "http://h/x", p, 1) for k, p in enumerate(pages)] + [(100 + k, f"http://other{k}/", pages[1], 1) for k in range(2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, part int")
    for group in (400, 1 << 20):
        got = {x.page_id: x.text for x in html.extract(table, group=group).collect()}
        assert [got[k] for k in range(len(pages))] == want
        assert got[100] == got[101] == html.main_texts([pages[1]])[0]
    assert html.extract(table.limit(0)).count() == 0


def test_html_of_short_and_long_pages():
    assert html.main_texts(["<p>Not Found</p>"]) == ["Not Found"]
    assert html.main_texts(["", "", ""]) == ["", "", ""]
    assert html.main_texts(["<p>x", "<p>x"]) == ["x", "x"]
    words = [f"w{k}" for k in range(300_000)]
    assert html.main_texts([f"<article><p>{' '.join(words)}</article>"]) == [" ".join(words)]
    assert html.main_texts(["<article><div class='search-results'>A</div><p>B</article>"]) == ["A\nB"]


def test_suffix_counts_equal_brute_force():
    r = random.Random(6)
    shared = [r.randrange(1000, 1100) for _ in range(12)]
    streams = [np.array([r.randrange(50) for _ in range(30)] + (shared if k % 2 else []) + [r.randrange(3) for _ in range(9)], np.uint64) for k in range(8)] + [np.zeros(0, np.uint64)]
    owners = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - 7):
            owners.setdefault(tuple(s[i : i + 8]), set()).add(k)
    found = html.substrings(streams)
    assert sorted(found.pages.tolist()) == sorted(len(x) for x in owners.values())
    assert len(set(found.mark.tolist())) == len(owners)
    for k, (s, mask) in enumerate(zip(streams, found.covered(found.pages >= 3), strict=True)):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 7):
            if len(owners[tuple(s[i : i + 8])]) >= 3:
                want[i : i + 8] = True
        assert (mask == want).all(), k


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _base(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 13 <= len(d) <= 19 and _luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0])))


def test_pii(spark):
    hard = [
        (1, "a@b.com_x@y.org z@@q.co a..b@c.d.e.f@g.hh"), (2, "1.2.3.4.5.6.7.8 0001.255.256.1 10.0.0.0255"), (3, "4111 1111 1111 1111, 4111-1111-1111-1112"), (4, "+1 (988) 555-2485 +12 ++4412345678 90"),
        (5, None), (6, ""), (7, "😀é a@b.cc +49 123 456 789."), (8, "1" * 9000 + " " + "a." * 5000 + "@"),
    ]
    got = {r.doc_id: r.spans for r in pii.report(pii.find(_docs(spark, hard))).collect()}
    assert got == {i: _base(t or "") for i, t in hard}
    told = [(i, f"word{'abcdefgh'[i % 8]} call Ackbar now x{'qwertzui'[i % 8]} a@b.cc") for i in range(8)] + [(100 + i, f"some now call other text {i}") for i in range(90)]
    clean = {r.doc_id: r.text for r in pii.sanitize(_docs(spark, told)).collect()}
    assert clean[0] == "worda call [TERM] now xq [EMAIL]" and clean[100] == "some now call other text 0"
    assert pii.find(_docs(spark, [])).count() == 0


def test_pii_scores_entities_of_one_document(spark):
    rows = [(i, f"some words of text {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}") for i in range(300)]
    rows += [(1000, "write Ackbar some words at x@y.org"), (1001, "write some words at z@y.org"), (1002, "write some words at z@y.org")]
    clean = {r.doc_id: r.text for r in pii.sanitize(_docs(spark, rows)).collect()}
    assert clean[1000] == "write [TERM] some words at [EMAIL]" and clean[1001] == clean[1002] == "write some words at [EMAIL]"
    assert clean[0] == rows[0][1]


def test_pii_with_clashing_names_and_long_texts(spark):
    text = "lorem ipsum " * 90_000 + "a@b.cc"
    names = "doc_id long, text string, base string, spans int, row int, own string, words string, found string, copy int, _own int"
    table = spark.createDataFrame([(1, text, "b", 5, 6, "o", "w", "f", 7, 8)], names)
    row = pii.find(table).first()
    assert [(x.kind, x.start, x.end) for x in row.base] == [(0, len(text) - 6, len(text))] and (row.row, row.own, row.words, row.found) == (6, "o", "w", "f")
    clean = pii.sanitize(table).first()
    assert clean.text == text[:-6] + "[EMAIL]" and (clean.base, clean.spans) == ("b", 5)


def test_pii_masks_revealing_terms_in_the_whole_document(spark):
    rows = [(i, f"some words of text {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}") for i in range(300)]
    rows += [(1000, "Ackbar says\n" + "some words of text " * 9 + "x@y.org\n12ackbar ACKBAR, ackbars some ackbar@q.de")]
    clean = {r.doc_id: r.text for r in pii.sanitize(_docs(spark, rows)).collect()}
    assert clean[1000] == "[TERM] [TERM]\n" + "some words of text " * 9 + "[EMAIL]\n[TERM] [TERM], [TERM] some [EMAIL]"


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    one = {r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == one
    safe = corpus_pipeline.remove_personal_data(spark, kept, sf)
    assert safe.columns == docs.columns and safe.count() == len(one)
    packed = corpus_pipeline.pack(spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == len(one)
