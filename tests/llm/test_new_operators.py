"""Infilling, lexical search, BPE, and rows with repeated or null ids."""

import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidegauge.llm import bpe, decontaminate, infill, lexical_search, substring_dedup  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "doc_id long, text string, row long, name string, query int, n long"
TEXTS = [None, "", " \n", "a", "ümläut 日本語 😀", "holds <P> inside", "<S", "x" * 20_000, "word " * 9_000, "tie one", "tie one"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def odd_rows(spark, extra=()):
    rows = [(i, t, 7, "n", 1, 2) for i, t in enumerate([*TEXTS, *extra])]
    return spark.createDataFrame([*rows, (None, "null id text here", 0, None, None, None), (3, "again", 0, "", 0, 0), (3, "again", 0, "", 0, 0)], ODD).repartition(3)


def draws(doc_id):
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def infilled(doc_id, text):
    text = text or ""
    n, (h1, h2, h3, h4) = len(text), draws(doc_id)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infilling_equals_plain_slicing_and_restores(spark):
    rng = random.Random(3)
    docs = odd_rows(spark, ["".join(rng.choice("aé日😀 <") for _ in range(rng.choice((3, 50, 4095, 4096, 4097, 8192, 13_000)))) for _ in range(60)])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.collect():
        n, form, p, m, out = infilled(r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or "")))
    key = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, infill.infill_digests(docs).collect()), key=key) == sorted(want, key=key)
    moved = infill.fill_in_middle(infill.frame_texts(docs))
    assert sorted(map(tuple, infill.output_digests(moved).collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.infill_digests(docs.limit(0)).count() == 0


def test_a_cut_reads_only_its_frame():
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    frames = next(infill._frames(infill.pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})))
    frames, before = frames["frames"][0], frames["before"][0]
    assert before == [0, 4096, 8192] and infill.seek(frames, before, 5000) == (1, text[4096:5000], text[5000:8192])
    for lo, hi in ((0, 0), (0, 4096), (4096, 10_000), (10, 20), (4000, 9000), (8192, 10_000), (0, 10_000)):
        part = infill._span(frames, before, len(text), lo, hi)
        assert b"".join(infill.stream(part)).decode() == text[lo:hi]
    # whole frames are taken over as they are
    assert infill._span(frames, before, len(text), 10, 10_000)[1:] == frames[1:]


def test_trie_encodes_as_the_library(vocabulary):
    library, coder, rng = Tokenizer.from_file(PATH), bpe.TextEncoder(vocabulary), random.Random(5)
    letters = ["ab", "aaab", "etaoinshrdlu ", "0123 a", "'s't're've'll'd'm xX", "éñüßÅ aİ", "漢字かな ab", "́eé AΣ", "😀👍🏽 a", "=-_*#", " \t\n\x85\xa0\x1c\x1d\0a"]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [chr(c) + "a" + chr(c) + chr(c) + "1" + chr(c) for c in range(0x2100)]
    texts += ["a" * 3000, "=" * 2000, "".join(rng.choice("ab") for _ in range(9000)), "<|startoftext|>Hi<|endoftext|><|ENDOFTEXT|>", "\0<|startoftext|>", ""]
    for text, packed, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, text[:60]
        assert coder.decode(packed) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(spark, vocabulary):
    docs, library = odd_rows(spark), Tokenizer.from_file(PATH)
    want = sorted((str(r.doc_id), tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    coded = bpe.encode_texts(docs, vocabulary)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in coded.collect()) == want
    assert sorted(map(tuple, bpe.decode_ids(coded, vocabulary).select("text").collect())) == sorted((library.decode(list(ids), skip_special_tokens=False),) for _, ids in want)
    assert bpe.encode_texts(docs.limit(0), vocabulary, decoded=True).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    total, length, out = len(held), sum(len(w) for _, w in held), set()
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, asked in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in asked}
        scores = []
        for i, w in held:
            m = 10 + 90 * len(w) * total // length
            scores.append((-sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked), math.inf if i is None else i, i))
        out |= {(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: x[:2])[:top])}
    return out


@pytest.mark.parametrize("probes,block_bytes", [(64, 1 << 20), (10, 60)])
def test_search_equals_brute_force(spark, probes, block_bytes):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Émile", "日本", "a_b", "X9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 40, 300))))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 340)] + [(5, "w1 w2"), (5, "w1 w2"), (None, docs[7][1]), (400, None), (401, "?!"), (402, "w1 " * 20_000)]
    items = [(k, docs[k][1]) for k in range(0, 12)] + [(20, None), (21, "..."), (22, "w1"), (3, "w77 w78"), (23, "nowhere"), (24, "w1")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, key long, bound long").repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")
    got = lexical_search.search_documents(frame, asked, probes=probes, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(x for x in ranked(docs, items, 10) if x[2] is not None)
    assert len(got) == len(ranked(docs, items, 10))
    assert lexical_search.search_documents(frame.limit(0), asked).count() == 0 and lexical_search.search_documents(frame, asked.limit(0)).count() == 0


def test_signature_bounds_hold_for_every_document():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, n)) for n in rng.integers(1, 200, 100)]
    offs, data = lexical_search.text_buffers(lexical_search.pa.array(texts))
    words = lexical_search.words_of(offs, data, lower=True, plain=True)
    names = np.unique(words.name)
    queries = lexical_search.Queries([0, 1], names, [np.arange(len(names)), np.arange(0, len(names), 3)], np.arange(len(names), dtype=np.int64) % 97, 100, int(words.counts.sum()))
    exact = lexical_search.exact_scores(queries, words, [np.array([0, 1])] * len(texts))
    of, name, times = lexical_search.term_counts(words)
    width = 1024
    bits = np.zeros((width, 104), dtype=bool)
    for level in lexical_search.LEVELS:
        for t in range(len(texts)):
            bits[lexical_search.places(name[(of == t) & (times >= level)], level, width).ravel(), t] = True
    slices = np.packbits(bits, axis=1).ravel()
    bounds = dict(lexical_search.bounds_of(queries, width, words.counts, slices))
    assert all(bounds[q][t] >= exact[t][q] for q in (0, 1) for t in range(len(texts)))
    assert (bounds[1] <= 2 * np.array([e[1] for e in exact])).mean() > 0.9


# --- rows that repeat an id ---------------------------------------------------------------------


def passages(*names, n=60):
    return {x: " ".join(f"{x}{k}" for k in range(n)) for x in names}


def test_substring_dedup_of_repeated_ids(spark):
    p = passages("P", "A", "B", "Q", "L")
    rows = [(1, p["P"]), (2, p["A"] + " " + p["P"]), (2, p["B"]), (3, p["Q"]), (4, p["L"]), (4, p["L"] + " " + p["P"]), (None, p["P"])]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, gone string, row string").repartition(2)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame).collect())
    assert got == sorted([("1", 60, 0), ("2", 120, 60), ("2", 60, 0), ("3", 60, 0), ("4", 60, 0), ("4", 120, 60), ("None", 60, 0)])
    kept = substring_dedup.without_repeats(frame)
    assert kept.columns == frame.columns and sorted(len(r.text.split()) for r in kept.collect()) == [60] * 7


def test_near_duplicates_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    p = passages("P", "Q", "R")
    rows = [(1, p["P"]), (5, p["P"]), (5, p["Q"]), (8, p["Q"] + " z"), (None, p["P"]), (9, p["R"]), (9, p["R"]), (10, ""), (10, ""), (None, None), (None, p["R"] + " z")]
    frame = spark.createDataFrame([(i, t, "k", False) for i, t in rows], "doc_id long, text string, key string, once boolean").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in got.collect()) == sorted([("1", "P0"), ("5", "Q0"), ("9", "R0"), ("10", ""), ("10", ""), ("None", "")])
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_decontamination_judges_each_row_in_every_block_count(spark):
    p = passages("I", "J", "K", n=30)
    items = spark.createDataFrame([(0, p["I"]), (1, p["J"]), (2, p["K"])], "item_id long, text string")
    docs = spark.createDataFrame([(7, "before " + p["I"]), (7, "clean text " * 20), (None, p["J"] + " " + p["K"]), (8, None), (9, "")], "doc_id long, text string")
    want = [(str(7), [0]), (str(7), []), ("None", [1, 2]), ("8", []), ("9", [])]
    for block in (1, 2, 4096):
        found = decontaminate.find_contaminated(docs, items, block_items=block).collect()
        assert sorted((str(r.doc_id), r["items"]) for r in found) == sorted(want) and all(r.contaminated == bool(r["items"]) for r in found)
    assert decontaminate.find_contaminated(docs.limit(0), items).count() == 0 and decontaminate.find_contaminated(docs, items.limit(0)).where("contaminated").count() == 0
