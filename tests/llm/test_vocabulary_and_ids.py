"""Spelling variants, token files and the source audit against brute force, SQL and awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadmosaic.lineage import exists
from quadmosaic.llm import divergence, spelling, tokens
from quadmosaic.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("word", "n", "near", "run", "h", "id", "ts", "part", "term", "once", "size", "salt", "shard", "place", "tie", "row", "ids", "n_tokens", "start", "item", "value", "rank", "p", "q", "docs", "said", "v")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, very long ones, ties, repeated rows, and clashing columns."""
    long = "words Wordz sword " * 30_000 + "a" * 70_000 + " <|endoftext|> don't stop\x1cnow é ́x"
    data = [(1, None, "en", "s", 1), (2, "", "en", None, None), (3, " \n\t\n", None, "s", 3), (None, "worda wordb Wordb", "en", "s", 4), (None, None, None, None, None), (4, long, "en", "s", 5)]
    data += [(5, "naïve naive NAIVE naivé", "fr", "t", 6)] * 3 + [(5, "other text of five", "fr", "t", 6), (7, "日本語 ünïcödé İ ς Σ × ÷", "de", "u", 7), (None, "worda wordb Wordb", "en", "s", 4)]
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


# spelling variants


def brute_words(docs, noise=97, least=3, length=5):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= least and len(w) >= length}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def as_set(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_neighbourhood_has_each_edit_once():
    rnd = random.Random(3)
    alphabet = ["a", "b", "é", "日"]
    words = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 7))) for _ in range(60)})
    found = [(w, x) for ws, xs in spelling.neighbours(words, alphabet) for w, x in zip(ws, xs)]
    want = set()
    for w in words:
        want |= {(w, w[:i] + w[i + 1 :]) for i in range(len(w))}
        want |= {(w, w[:i] + c + w[i + 1 :]) for i in range(len(w)) for c in alphabet if c != w[i]}
        want |= {(w, w[:i] + c + w[i:]) for i in range(len(w) + 1) for c in alphabet}
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("power", [15, 22])
def test_variants_against_brute_force(spark, power, monkeypatch):
    monkeypatch.setattr(spelling, "LEAST_POWER", power)
    monkeypatch.setattr(spelling, "MOST_POWER", power)
    rnd = random.Random(5)
    n = {"".join(rnd.choice("abéz") for _ in range(rnd.randint(1, 6))): rnd.choice([3, 3, 4, 6, 8, 12, 16, 100]) for _ in range(500)}
    n |= {"b" * 5000: 40, "b" * 5001: 3, "b" * 2000 + "a" + "b" * 3000: 7, "": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_set(spelling.variants(df)) == brute_variants(n)


def test_links_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", -1)
    n = {"x" * (5 + i): 3 * 2**i for i in range(20)}  # a chain of twenty words
    got = as_set(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_variants(n) and {r[2] for r in got} == {"x" * 24}


def test_spelling_query(spark, small, rows):
    assert as_set(QUERIES["op11_spelling"](spark, small)) == brute_variants(brute_words([r[:2] for r in rows]))


def test_spelling_of_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for noise in (97, 1, 2):
        assert as_set(spelling.spelling_variants(odd, 1, noise)) == brute_variants(brute_words(docs, noise, 1))
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(odd, 1)


# token files


def brute_tokens(docs):
    library = Tokenizer.from_file(tokens.public_tokenizer("word_bpe_49k.json"))
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]
    return ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_query(spark, small, rows):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op12_tokens"](spark, small).collect()}
    start = 0
    for doc_id, ids in sorted(brute_tokens([r[:2] for r in rows])):
        assert got.pop(doc_id) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_the_whole(rows, odd, name):
    library = Tokenizer.from_file(tokens.public_tokenizer(name))
    rnd = random.Random(9)
    signs = ["a", "the", "Word", "S", "VE", "(", "\"", "<|", "É", "é", "́", " ", "\n", "\r", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "'s", "'", "<|endoftext|>", "1", "½", "你", "🙂", "İ", "ΑΣ", "ﬁ", "가", "가", ".", "--", "\x00"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [r[1] for r in rows] + [r.text for r in odd.collect()]
    encode = tokens.encoder(tokens.public_tokenizer(name), cache_pieces=500)
    for text in texts:
        assert encode(text).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_tokens_of_odd_rows(spark, odd, tmp_path):
    folder = str(tmp_path / "t")
    tokens.write_tokens(odd, folder, tokens.public_tokenizer("word_bpe_49k.json"))
    got = tokens.digest(tokens.read_tokens(spark, folder)).collect()
    want = brute_tokens([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_tokens_of_an_empty_table(spark, odd, tmp_path):
    folder = str(tmp_path / "t")
    tokens.write_tokens(odd.limit(0), folder, tokens.public_tokenizer("word_bpe_49k.json"))
    assert tokens.digest(tokens.read_tokens(spark, folder)).count() == 0


def test_files_have_encodings_groups_and_page_indexes(spark, small, tmp_path, monkeypatch):
    monkeypatch.setitem(tokens.FILE_OPTIONS, "parquet.page.row.count.limit", "20")
    folder = str(tmp_path / "t")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tokens.write_tokens(docs, folder, tokens.public_tokenizer("word_bpe_49k.json"))
    files = sorted(ds.dataset(f"{folder}/ids").files)
    rows = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["place"].encodings
            lists = next(c for p, c in columns.items() if p.startswith("ids"))
            assert "RLE_DICTIONARY" in lists.encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert rows == docs.count()
    # some documents, and metadata alone: neither other row groups' pages nor the ids are read
    some = tokens.read_tokens(spark, folder, (40, 60))
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,40), LessThanOrEqual(doc_id,60)" in plan
    assert sorted(r.doc_id for r in some.collect()) == list(range(40, 61))
    few = tokens.read_tokens(spark, folder, columns=("doc_id", "start", "n_tokens"))
    assert "ids:array" not in few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == rows


def test_query_leaves_no_files(spark, small):
    folders = []
    real = tokens.scratch
    tokens.scratch = lambda *a: folders.append(real(*a)) or folders[-1]
    try:
        QUERIES["op12_tokens"](spark, small)
    finally:
        tokens.scratch = real
    assert len(folders) == 1 and not exists(spark, folders[0])


# the audit


def brute_audit(docs, min_docs, top=50):
    seen, n = {}, {}
    groups = set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        for t in set(found):
            seen[lang, t] = seen.get((lang, t), 0) + 1
        for t in found:
            n[lang, source, t] = n.get((lang, source, t), 0) + 1
    out = set()
    for lang in {g[0] for g in groups}:
        own = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), k in seen.items() if x == lang and k >= min_docs]

        def shares(counts):
            whole = sum(counts) + 5 * len(kept)
            return [1 + 10**9 * (c + 5) // whole for c in counts]

        count = {s: [n.get((lang, s, t), 0) for t in kept] for s in own}
        p = {s: shares(count[s]) for s in own}
        q = shares([sum(count[s][i] for s in own) for i in range(len(kept))])
        for s in own:
            pair = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in own if o != s]
            term = [(p[s][i] - q[i], t) for i, t in enumerate(kept) if count[s][i] and p[s][i] > q[i]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found if part == "pair" else found[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 3), (30, 50), (10**6, 50)])
def test_audit_against_brute_force(spark, small, rows, least, top):
    got = [tuple(r) for r in divergence.audit(spark.read.parquet(f"{small}/documents.parquet"), least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit([r[1:] for r in rows], least, top)


def test_audit_of_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    for least in (1, 2):
        assert {tuple(r) for r in divergence.audit(odd, least).select("lang", "source", "part", "item", "value", "rank").collect()} == brute_audit(docs, least)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_shares_are_exact(spark):
    big = 10**17
    one = spark.range(1).select(divergence._share(F.lit(big).cast("long"), F.lit(3 * big + 1).cast("long")).alias("p")).first().p
    assert one == 1 + 10**9 * (big + 5) // (3 * big + 1)
