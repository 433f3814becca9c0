"""The training-data operators against brute force, the libraries themselves, round trips and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import Row
from pyspark.sql import functions as F

from sluice.llm import audio_core, bpe, components, crf_core, dac, decontaminate, forest, language, media, pieces, quality, registry, ring_core, secret_core, secrets, sharding, simhash, simhash_core, token_count, token_store, words
from sluice.llm.common import materialise, read_table

LONG = "palabra " * 40_000
TEXTS = [None, "", " \n\t ", "a", "two words", "The quick brown fox jumps over the lazy dog. " * 3, "The quick brown fox jumps over the lazy dog. " * 3, "ÉCOLE élève çà <|endoftext|> it's 1234 !!", "a\x1cb\x1d c\x85d　e", "中文 テスト 🙂", LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, equal ids, odd and very long texts."""
    rows = [(k, t, "en" if k % 2 else "fr", f"src{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "the null id", None, None, None), (3, "same id, other text", "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def real(spark):
    return read_table(spark, DATA, "documents")


def clashing(df):
    """With columns that have the names of results."""
    out = df
    for c in CLASHES:
        out = out.withColumn(c, F.lit("x"))
    return out


CLASHES = (
    "score", "n_tokens", "shard", "slot", "size", "text_crc32", "row", "fp", "start", "first", "arc", "at", "key", "media", "begin", "secret", "_head", "_n", "_bad",
    "part", "text_key", "kept", "kept_id", "rows", "n", "stays", "component_id", "node", "root", "run", "item_id", "draw", "share", "k", "place", "quality", "tie", "ids", "path",
)


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


# op1 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def secret_model(spark, real):
    return secrets.fit(spark, real, sample=200)


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(int)
    f = forest.fit(x[:1000], y[:1000], trees=20)
    assert ((f.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert len(f.predict(np.empty((0, 5)))) == 0


def test_candidates_are_character_spans():
    text = 'é password = "hunter2!x" ü 4785380592391139 abcdefghijklmnopqrstu 0123456789abcdef01'
    assert [text[a:b] for a, b in secret_core.candidates(text)] == ["hunter2!x", "4785380592391139", "0123456789abcdef01"]
    assert secret_core.candidates("") == []


def test_long_values_are_whole():
    for value in (".".join(["eyJ0k3n" * 20] * 12), "%2Fq7".join(["ab"] * 300)):
        text = f"see api_key = '{value}', then"
        assert [text[a:b] for a, b in secret_core.candidates(text)] == [value]


def test_held_out_findings(spark, secret_model):
    held = secret_core.labelled_findings(["some", "other", "words", "here"], 600, seed=99)
    x = np.array([secret_core.features(v, b, a, p, secret_model.language) for v, b, a, p, _ in held])
    right = (secret_model.trees.predict(x) >= 0.5) == np.array([y for *_, y in held])
    assert right.mean() > 0.93


def test_scan_and_redact(spark, docs, secret_model):
    more = spark.createDataFrame([(50, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "en", "src1", 60), (51, "card 4785380592391139 paid", "en", "src1", 26)], SCHEMA)
    all_ = docs.unionByName(more)
    found = secrets.scan(spark, all_, secret_model).filter("secret").collect()
    assert {r.doc_id for r in found} == {50}
    masked = {r.doc_id: r for r in secrets.redact(spark, clashing(more), secret_model).collect()}
    assert masked[50].text == 'x token = "[SECRET]" y' and masked[50].n_chars == len(masked[50].text) and masked[51].text == "card 4785380592391139 paid"
    assert secrets.scan(spark, clashing(docs.limit(0)), secret_model).count() == 0
    assert bag(secrets.redact(spark, docs, secret_model).collect()) == bag(docs.collect())


def test_dictionary_and_transitions_are_of_all_documents(spark):
    """25,000 words in two documents each, one word in every and one in a single document; more documents than a thousand."""
    rng = random.Random(8)
    vocabulary = sorted({"".join(rng.choice("abcdefghijklm") for _ in range(8)) for _ in range(25_200)})[:25_000]
    texts = [" ".join(["Every", *vocabulary[k::1250]]) for k in range(1250)] * 2 + ["every solitary", None, ""]
    df = spark.createDataFrame([(k if k % 7 else None, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    model = secrets.fit(spark, df)
    assert model.language.words == {*vocabulary, "every"}
    pairs: dict[str, int] = {}
    for w, n in [*((w, 2) for w in vocabulary), ("every", 2501), ("solitary", 1)]:
        for a, b in zip("^" + w, w + "$", strict=True):
            pairs[a + b] = pairs.get(a + b, 0) + n
    firsts = {a: sum(n for p, n in pairs.items() if p[0] == a) for a in {p[0] for p in pairs}}
    assert model.language.steps.keys() == pairs.keys()
    assert all(abs(model.language.steps[p] - np.log(n / firsts[p[0]])) < 1e-12 for p, n in pairs.items())
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 2), ("e", 1)], "word string, n long")
    assert [sorted(secrets._frequent(counts, 2, most)) for most in (9, 4, 3, 2, 0)] == [list("abcd"), list("abcd"), list("abc"), ["a"], []]


def test_all_planted_tokens_are_found(spark, real, secret_model):
    rng, planted, rows = random.Random(12), set(), []
    for r in real.limit(60).collect():
        head = r.text[:50]
        rows.append((r.doc_id, f'{head} token = "{rng.randbytes(20).hex()}" {r.text[50:]}', r.lang, r.source, 0))
        planted.add((r.doc_id, len(head) + 10, len(head) + 50))
    found = {(r.doc_id, r.begin, r.end) for r in secrets.scan(spark, spark.createDataFrame(rows, SCHEMA), secret_model).filter("secret").collect()}
    assert planted <= found and len(found) <= 1.1 * len(planted)


# op2 ---------------------------------------------------------------------------------------------


def test_pieces_are_the_text_and_safe():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "é", "1", "!", "\x1c", "　", "'s", "\r\n", "\x85"]) for _ in range(rng.randint(0, 30)))
        assert "".join(pieces.safe_pieces(text)) == text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, docs, plain, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, k=Tokenizer.from_file(path): len(k.encode(t, add_special_tokens=False))
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 512) for d, t in plain]
    assert bag(token_count.token_counts(clashing(docs), path).collect()) == bag(want)
    assert token_count.token_counts(docs.limit(0), path).count() == 0


def test_token_counts_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(7)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "The", "é", "1", "!!", "\x1c", "\x1f", "　", "'s", "<|endoftext|>", "\x85", "​"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert token_count.counter(path)(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_memo_stays_bounded():
    memo = pieces.Memo(lambda xs: [len(x) for x in xs], limit=3)
    known = memo.learn([["a", "bb"], ["ccc", "dddd", "e" * 100]])
    assert known["dddd"] == 4 and known["e" * 100] == 100 and len(memo) <= 3
    assert memo.learn([["a", "zz"]])["zz"] == 2 and len(memo) <= 3


# op3 ---------------------------------------------------------------------------------------------


def brute_counts(text):
    import re

    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + re.sub(" +", " ", low).strip() + " "
    out = {}
    for n in range(1, 5):
        for k in range(len(low) - n + 1):
            g = low[k : k + n]
            if " " not in g[1:-1] and g.strip() and (n > 1 or g != " ") and not (n > 1 and g[0] == " " and g[-1] == " "):
                out[g] = out.get(g, 0) + 1
    return out


def test_gram_counts_equal_brute_force():
    from sluice.llm.language_core import gram_counts

    texts = ["", "a", "Ab ab, AB!", "élève du lycée 12 l'été", "  x  "]
    group, _, counts = gram_counts(texts, np.arange(len(texts)))
    for k, t in enumerate(texts):
        want = brute_counts(t) if any(c.isalpha() for c in t) else {}
        assert sorted(counts[group == k].tolist()) == sorted(want.values())


def test_held_out_languages(spark, real):
    got = registry.QUERIES["op3_language_id"](spark, DATA).join(real.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_language_edges(spark, docs, real):
    profiles = language.fit_profiles(spark, real.select("doc_id", "text", "lang"), per_language=20)
    got = language.identify(spark, clashing(docs), profiles).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {0, 1, 2}
    assert language.identify(spark, docs, language.fit_profiles(spark, real.limit(0).select("doc_id", "text", "lang"))).filter("lang_pred <> 'und' OR score <> 0").count() == 0
    kept = language.keep_known(spark, docs)
    assert kept.columns == docs.columns and kept.filter("text IS NULL").count() == 0
    assert language.keep_known(spark, docs.limit(0)).count() == 0


# op4 ---------------------------------------------------------------------------------------------


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for top in (1, 256, 257, 70_000, 1 << 32):
        for n in (0, 1, 511, 512, 513, 5000):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            s = dac.Segment(dac.encode(ids))
            assert len(s) == n and [s[k] for k in range(0, n, 7)] == ids[::7].tolist()
            for a, b in ((0, n), (n // 3, n // 2), (n, n)):
                assert s.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        s[n]


def brute_store(plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out, flat = 0, [], []
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64))
    for d, t in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
        start += len(ids)
    return out, flat


def test_store_equals_brute_force(spark, docs, plain, tmp_path):
    import public_tokenizers

    path, where = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store")
    token_store.write_store(spark, clashing(docs), path, where, segment=50)
    want, flat = brute_store(plain)
    assert bag(token_store.read_documents(spark, where).collect()) == bag(want)
    for a, b in ((3, 60), (5, 5), (0, len(flat)), (len(flat) - 1, len(flat) + 9), (700, 701)):
        assert token_store.tokens_at(spark, where, a, b) == flat[a:b]
    assert token_store.segments_with(spark, where, 3, 4).count() == 1
    empty = str(tmp_path / "empty")
    token_store.write_store(spark, docs.limit(0), path, empty)
    assert token_store.read_documents(spark, empty).count() == 0 and token_store.tokens_at(spark, empty, 0, 9) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_any_vocabulary_equals_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["The Quick brown fox", "", "  two  spaces\nhere", "É it's 12!", "x" * 300]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in token_store.encoder(path)(texts)] == want


def test_word_encoder_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    parts = [" ", "\n", "a", "B", "Th", "in", "1", "23", ".", "!!", "'s", "'", "é", "É", "ß", "µ", "ª", "中", "́", "\x1c", "\x85", "½", "<|endoftext|>", "İ", "Σ", "ς", "ﬁ", "_", "×", "가"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in token_store.encoder(path)(texts)] == want


# op5 ---------------------------------------------------------------------------------------------


def brute_align(p, q):
    best, h = 0, np.zeros((len(q) + 1, len(p) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == p[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        q = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64)
        ps = [rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(4)]
        qs = [q, q[: len(q) // 2 + 1], rng.integers(1, 6, 5).astype(np.uint64), q]
        score, begin, end = decontaminate.align(ps, qs)
        assert score.tolist() == [brute_align(p, x) for p, x in zip(ps, qs, strict=True)]
        for p, x, s, a, b in zip(ps, qs, score, begin, end, strict=True):
            assert brute_align(p[a:b], x) == s


def test_words_and_grams():
    which, begin, end, h = words.words_of(["Ab cd", "", "ab!cd x"])
    assert which.tolist() == [0, 0, 2, 2, 2] and begin.tolist() == [0, 3, 0, 3, 6] and end.tolist() == [2, 5, 2, 5, 7]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert words.grams(h[:2], 2)[0] == words.grams(h[2:4], 2)[0] and len(words.grams(h[:1], 2)) == 0


def test_copied_edited_and_clean(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    edited = [w if k % 9 else "changed" for k, w in enumerate(item)]
    dropped = item[:15] + item[18:]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bodies = [item, edited, dropped, item[:12], filler(40)]
    rows = [(k, " ".join([*filler(30), *body, *filler(30)])) for k, body in enumerate(bodies)] + [(5, None), (6, ""), (7, " ".join(item).upper()), (7, " ".join(item)), (None, " ".join(item))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "!!"), (5, "changed changed")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(spark, clashing(d), b).collect()}
    assert set(got) == {0, 1, 2, 7, None} and got[0].score == 1.0 and (got[0].begin_word, got[0].end_word) == (30, 70)
    assert bag((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(spark, d, b, block_bytes=64).collect()) == bag((r.doc_id, r.item_id, r.score) for r in got.values())
    assert decontaminate.contaminated(spark, d, b.limit(0)).count() == 0 and decontaminate.contaminated(spark, d.limit(0), b).count() == 0
    more = d.unionByName(spark.createDataFrame([(0, "clean row of a shared id"), (None, "clean row without an id"), (0, "clean row of a shared id")], d.schema))
    for block in (64, 1 << 20):
        kept = decontaminate.drop_contaminated(spark, clashing(more), b, block_bytes=block)
        assert kept.columns == clashing(more).columns
        assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 0, 0, 3, 4, 5, 6]
    assert decontaminate.drop_contaminated(spark, d, b.limit(0)).count() == d.count() and decontaminate.drop_contaminated(spark, d.limit(0), b).count() == 0
    twice = decontaminate.contaminated(spark, d.filter("doc_id = 0").union(d.filter("doc_id = 0")), b.union(b)).collect()
    assert [(r.doc_id, r.item_id) for r in twice] == [(0, 1)]  # one row for each id and item


def test_short_items_and_long_texts(spark):
    """Items of one to six words count only whole or by five words; a very long text, and ties between two equal passages."""
    long = " ".join(f"w{k}" for k in range(60_000))
    item = " ".join(f"w{k}" for k in range(50_000, 50_030))
    d = spark.createDataFrame([(1, long), (2, "so one two three four is"), (3, "one two three"), (4, f"{item} x y z {item}"), (5, "ab ab ab")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "one two three four"), (3, "w7"), (4, "no one two three found"), (5, "ab ab")], "item_id long, text string")
    got = bag((r.doc_id, r.item_id, r.begin_word, r.end_word) for r in decontaminate.contaminated(spark, d, b).collect())
    assert got == bag([(1, 1, 50_000, 50_030), (1, 3, 7, 8), (2, 2, 1, 5), (4, 1, 0, 30), (5, 5, 0, 2)])


def test_edits_everywhere_equal_brute_force(spark):
    """Every 6th to 8th word replaced, intact copies and lone runs of the items elsewhere: each pair that shares five words scores as brute force says."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [filler(30 + k) for k in range(12)]
    bodies = [[w if k % step != step - 1 else f"edit{k}" for k, w in enumerate(item)] for item in items for step in (6, 7, 8)] + items[:4] + [item[:20] for item in items]
    texts = [[*filler(70), *body, *filler(70)] for body in bodies]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    runs = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    want, sure = {}, set()
    for i, item in enumerate(items):
        for k, t in enumerate(texts):
            score = brute_align([number[w] for w in t], [number[w] for w in item]) / (2 * len(item))
            if score >= decontaminate.THRESHOLD:
                want[k, i] = score
                if runs(t) & runs(item):
                    sure.add((k, i))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(spark, d, b).collect()}
    assert len(want) >= 3 * len(items) and sure <= set(got) and all(want[x] == y for x, y in got.items())


def test_recall_against_alignment_of_all_pairs(spark, real):
    """Copies edited at random (words replaced, dropped, put in) or at every few words, inside real documents."""
    rng = random.Random(21)
    items = read_table(spark, DATA, "benchmark").orderBy("item_id").limit(25).collect()
    vocabulary = sorted({w for r in real.limit(60).collect() for w in r.text.split()})

    def edited(text, rate, step):
        out = []
        for k, w in enumerate(text.split()):
            if (step and k % step == step - 1) or rng.random() < rate:
                how = rng.random()
                out += [rng.choice(vocabulary)] if how < 0.6 else [] if how < 0.8 else [w, rng.choice(vocabulary)]
            else:
                out.append(w)
        return " ".join(rng.sample(vocabulary, 20) + out + rng.sample(vocabulary, 20))

    kinds = [(r, 0) for r in (0.05, 0.1, 0.15, 0.2, 0.25)] + [(0.0, s) for s in (4, 5, 6, 7, 8)]
    texts = [edited(r.text, *kind) for kind in kinds for r in items]
    _, _, _, h = words.words_of(texts + [r.text for r in items])
    which = words.words_of(texts + [r.text for r in items])[0]
    cuts = np.searchsorted(which, np.arange(len(texts) + len(items) + 1))
    w = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    own = w[len(texts) :]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(real.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, d, spark.createDataFrame(items)).filter("doc_id < 10000").collect()}
    for n, _ in enumerate(kinds):
        want = set()
        for k in range(n * len(items), (n + 1) * len(items)):
            score, _, _ = decontaminate.align([w[k]] * len(items), own)
            want |= {(k, r.item_id) for r, s, q in zip(items, score.tolist(), own, strict=True) if s >= len(q)}
        assert len(want) >= 0.9 * len(items) and len(want & got) >= 0.9 * len(want), kinds[n]


def test_all_exact_leaks_are_found(spark, real):
    items = {r.item_id: r.text for r in read_table(spark, DATA, "benchmark").collect()}
    leaks = {(r.doc_id, k) for r in real.collect() for k, t in items.items() if t in r.text}
    found = {(r.doc_id, r.item_id) for r in registry.QUERIES["op5_benchmark_decontamination"](spark, DATA).collect()}
    assert leaks and leaks <= found and len(found - leaks) <= 0.1 * len(leaks)


# op6 ---------------------------------------------------------------------------------------------


def test_messages_equal_brute_force():
    rng = np.random.default_rng(3)
    n_lines = np.array([1, 4, 3, 6])
    x = rng.normal(size=(14, 3))
    crf = crf_core.Crf(np.zeros(3), np.ones(3), rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    emit, head, marginal, _ = crf.messages(x, n_lines)
    at = 0
    for n in n_lines.tolist():
        p = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(crf.begin[path[0]]) * np.prod([emit[at + k, s] for k, s in enumerate(path)]) * np.prod([np.exp(crf.trans[a, b]) for a, b in zip(path, path[1:], strict=False)])
            for k, s in enumerate(path):
                p[k, s] += w
        assert np.allclose(p / p.sum(axis=1, keepdims=True), marginal[at : at + n])
        at += n


def test_line_features():
    own, length, n_lines = crf_core.line_features(["Ab c.\n\nAb c.", "", "For For For"])
    by = lambda name: own[:, crf_core.NAMES.index(name)].tolist()
    assert n_lines.tolist() == [3, 1, 1] and length.tolist() == [5, 0, 5, 0, 11]
    assert by("repeated") == [1, 0, 1, 0, 0] and by("empty") == [0, 1, 0, 1, 0] and by("ends_sentence") == [1, 0, 1, 0, 0]
    assert by("echo")[4] == pytest.approx(2 / 3) and by("echo")[0] == 0


def test_held_out_quality(spark):
    got = registry.QUERIES["op6_quality_classifier"](spark, DATA).filter("held_out").join(read_table(spark, DATA, "labels"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert got.count() > 0 and right >= 0.9


def test_quality_edges(spark, docs, real):
    labels = read_table(spark, DATA, "labels")
    crf = quality.fit_quality(spark, real, labels, per_class=40)
    got = quality.score(spark, clashing(docs), crf).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.fit_quality(spark, real, labels.limit(0)) is None
    assert {r.score for r in quality.score(spark, docs, None).collect()} == {0.5}
    assert quality.score(spark, docs.limit(0), crf).count() == 0
    assert len(quality.score_lines(spark, docs.filter("doc_id = 2"), crf).first().good) == 2


# op7 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                    label[i], changed = label[j], True
    out = []
    for k, (d, f) in enumerate(fps):
        ids = [x for (x, _), y in zip(fps, label, strict=True) if y == label[k] and x is not None]
        out.append((d, f"{f:016x}", min(ids, default=None)))
    return out


def component_rows(spark, df, **kw):
    got = simhash.simhash_components(spark, df, **kw)
    return bag((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect())


def test_components_equal_brute_force(spark, docs, plain):
    assert component_rows(spark, clashing(docs)) == bag(brute_components(plain))
    assert simhash.simhash_components(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [8, 16_384])
def test_dense_groups(spark, hot):
    """Near copies of one text; a low bound deals keys in blocks."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "x"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, " ".join(rng.sample(base, 40))) for k in range(60)]
    assert component_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot) == bag(brute_components(rows))


def test_plans_keep_the_pigeonhole():
    rng = np.random.default_rng(8)
    sample = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (0, 1000, 300_000, 10**8, 10**10):
        parts = simhash_core.plan(sample, n)
        assert sum(t + 1 for _, t, _ in parts) == 5
        for mask, t, flips in parts:
            assert len(flips) == simhash_core.n_variants(mask.bit_count(), t) == len(set(flips))
    assert simhash_core.plan(np.empty(0, np.uint64), 0)
    assert simhash_core.allocate([[1, 2, 99, 99, 99], [5, 99, 99, 99, 99], [1, 99, 99, 99, 99], [1, 99, 99, 99, 99]], 4) == (9, [1, 0, 0, 0])


def test_probes_find_what_index_alone_misses(spark):
    fps = [0, 0b1111, (1 << 63) | 1, 1 << 40, 12345678901234567]
    d = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    sig = simhash.signatures(d, [((1 << 32) - 1, 2, simhash_core.flips(list(range(32)), 2)), (((1 << 32) - 1) << 32, 1, simhash_core.flips(list(range(32, 64)), 1))])
    assert sig.filter("fp = 0").count() == simhash_core.n_variants(32, 2) + simhash_core.n_variants(32, 1)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (3, 4)]
    got = components.connected_components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 130)}
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sketch(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0, 0
    each = {xxhash.xxh64_intdigest(x.encode(), 42) for x in w}
    shingles = {xxhash.xxh64_intdigest(" ".join(w[k : k + 5]).encode(), 42) for k in range(max(1, len(w) - 4))}

    def mixed(x):
        top = (1 << 64) - 1
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & top
        return x ^ (x >> 31)

    most = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    columns = [[s if k == 0 else mixed((s + k) & ((1 << 64) - 1)) for s in shingles] for k in range(4)]
    return most(each), sum(most(c) << 64 * k for k, c in enumerate(columns))


def brute_kept(rows):
    """(doc_id, text) of the rows that stay: of each group of near sketches the smallest doc_id, null last, then the smallest MD5."""
    most = simhash_core.wide_distance(0.8)
    sketches = [brute_sketch(t) for _, t in rows]
    label, out = list(range(len(rows))), set()
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                near = (sketches[i][0] ^ sketches[j][0]).bit_count() <= 4 and (sketches[i][1] ^ sketches[j][1]).bit_count() <= most
                if label[j] < label[i] and near:
                    label[i], changed = label[j], True
    for k in set(label):
        members = [r for r, x in zip(rows, label, strict=True) if x == k]
        out.add(min(members, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())))
    return out


def near_copies(n, seed=31):
    """Texts in groups: a base, copies with a word in forty changed, and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows = []
    for k in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        rows.append((10 * k, " ".join(base)))
        for j in range(k % 4):
            w = list(base)
            for _ in range(len(w) // 60 + 1):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((10 * k + j + 1, " ".join(w)))
    return rows


def test_keep_first(spark, docs, plain):
    kept = simhash.keep_first(spark, clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert bag((r.doc_id, r.text or "") for r in kept.collect()) == bag((d, t or "") for d, t in brute_kept(plain))
    assert simhash.keep_first(spark, docs.limit(0)).count() == 0
    rows = near_copies(40)
    got = simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(got.collect()) == bag(brute_kept(rows))


def test_sketches_find_shingle_sets_that_are_alike():
    """Over half of the pairs with a Jaccard similarity of five-word shingles of 0.8 or more; and no pair under a half."""
    rows = near_copies(120, seed=5)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    got = [simhash_core.sketch(t.encode()) for _, t in rows]
    assert [(a, int.from_bytes(b, "little")) for a, b in got[:30]] == [brute_sketch(t) for _, t in rows[:30]]
    fp, wide = np.array([a for a, _ in got], np.uint64), np.frombuffer(b"".join(b for _, b in got), np.uint64).reshape(-1, 4)
    verify = simhash_core.Verifier(fp, simhash_core.WORD_DISTANCE, wide, simhash_core.wide_distance(0.8))
    found = alike = 0
    for i in range(len(rows)):
        near = verify.near(np.full(len(rows) - i - 1, i), np.arange(i + 1, len(rows)))
        for j, ok in zip(range(i + 1, len(rows)), near.tolist(), strict=True):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert not ok or jaccard >= 0.5
            if jaccard >= 0.8:
                alike, found = alike + 1, found + ok
    assert alike > 50 and found >= 0.5 * alike


@pytest.mark.parametrize("dense", [False, True])
def test_links_keep_components_whole(dense):
    """Against all pairs of a row of its own and any other row under a key."""
    rng = np.random.default_rng(4)
    for size in (3, 30, 90, 700):
        fps = rng.integers(0, 1 << 62, size).astype(np.uint64)
        groups = rng.integers(0, 3 if dense else size // 3 + 1, size)
        fps = fps[groups] ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
        keys, own = np.sort(rng.integers(0, 2, size)), rng.random(size) < 0.5
        nodes = np.arange(size) + 100
        a, b = simhash_core.links(keys, own, nodes, simhash_core.Verifier(fps, 3))
        want = [(i, j) for i in range(size) for j in range(i) if keys[i] == keys[j] and (own[i] or own[j]) and int(fps[i] ^ fps[j]).bit_count() <= 3]

        def roots(edges):
            label = list(range(size))

            def top(x):
                while label[x] != x:
                    x = label[x]
                return x

            for i, j in edges:
                label[max(top(i), top(j))] = min(top(i), top(j))
            return [top(x) for x in range(size)]

        assert set(zip(a - 100, b - 100, strict=True)) <= {x for i, j in want for x in ((i, j), (j, i))}
        assert roots(zip(a - 100, b - 100, strict=True)) == roots(want)


def test_frequent_keys_go_by_broadcast(spark, docs, plain):
    got = simhash.simhash_components(spark, docs, common=5)
    assert bag((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect()) == bag(brute_components(plain))


# op8 ---------------------------------------------------------------------------------------------


def reference_encoding(path):
    import public_tokenizers
    import tiktoken

    from sluice.llm.bpe_core import load_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, docs, plain):
    path, pattern = bpe.production()
    want, library = [], reference_encoding(path)
    for d, t in plain:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(bpe.bpe_digests(clashing(docs), path, pattern).collect()) == bag(want)
    encoded = bpe.encode_texts(docs, path, pattern)
    assert bag((r.doc_id, bytes(r.decoded)) for r in bpe.decode_ids(encoded, path, pattern).collect()) == bag((d, (t or "").encode()) for d, t in plain)
    assert bpe.bpe_digests(docs.limit(0), path, pattern).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_on_odd_texts(name):
    import public_tokenizers

    from sluice.llm.bpe_core import Bpe, TextEncoder, load_ranks

    path, rng = public_tokenizers.path(name), random.Random(9)
    library, own = reference_encoding(path), TextEncoder(Bpe(load_ranks(path)), public_tokenizers.PATTERN)
    parts = [" ", "  ", "\n", "a", "th", "in", "1", "!!", "'s", "é", "中", "́", "\x1c", "\x85", "\xa0", "½", "<|endoftext|>", "​", "🙂", "zz", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, "ab" * 2000, " " * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_a_small_vocabulary_equals_merging_by_rank():
    from sluice.llm.bpe_core import Bpe, merged

    rng, trained = random.Random(10), 0
    while trained < 30:
        ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
        while len(ranks) < 15:
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            ranks.setdefault(a + b, len(ranks))
        if any(len(x) > 1 and len(merged(x, ranks, k)) != 2 for x, k in ranks.items()):
            with pytest.raises(ValueError, match="lower rank"):
                Bpe(ranks)
            continue
        trained += 1
        own = Bpe(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 18)))
            want = [ranks[piece]] if piece in ranks else [ranks[x] for x in merged(piece, ranks, len(ranks))]
            assert own.encode(piece) == want and own.decode(want) == piece


# op9 ---------------------------------------------------------------------------------------------


def test_sharding_laws(spark, docs, plain):
    got = sharding.assign(spark, clashing(docs)).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in plain)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    sizes = [len(per.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.assign(spark, docs.limit(0)).count() == 0


def test_one_text_over_all_shards(spark):
    d = spark.createDataFrame([(k, "same" if k % 3 else f"text {k}") for k in range(1000)], "doc_id long, text string")
    got = sharding.assign(spark, d).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and {r.n for r in got} == {125} and {r.m for r in got} == {124}


def test_equal_texts_stay_together_where_there_is_room(spark):
    d = spark.createDataFrame([(k, f"text {k // 4}") for k in range(4000)], "doc_id long, text string")
    got = sharding.assign(spark, d).join(d, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert got.filter("n > 1").count() <= 40


def test_dealing_is_bounded_and_moves_little():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000))

    def shards_of(n):
        nodes, owners = ring_core.virtual_nodes(n)
        arcs = ring_core.arcs_of(keys, nodes)
        counts = np.bincount(arcs, minlength=len(nodes)).tolist()
        placed = ring_core.deal(counts, owners.tolist(), [int(1.15 * 20_000 / n) + 1] * n)
        assert sum(x for *_, x in placed) == 20_000
        out = np.full(20_000, -1)
        for arc, first, shard, rows in placed:
            at = np.flatnonzero(arcs == arc)[first : first + rows]
            out[at] = shard
        return out

    a, b = shards_of(8), shards_of(9)
    assert np.bincount(a).max() <= 1.15 * 2500 + 1 and (a != b).mean() < 0.35


def test_written_shards(spark, docs, tmp_path):
    given = clashing(docs)
    sharding.write_shards(spark, given, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    own = ["shard_" if c == "shard" else "slot_" if c == "slot" else c for c in given.columns]
    assert back.columns == [*own, "slot", "shard"]
    assert bag(back.select(own).collect()) == bag(given.collect())
    assert bag(back.select("doc_id", "shard", "slot").collect()) == bag((r.doc_id, r.shard, r.slot) for r in sharding.assign(spark, docs).collect())
    sharding.write_shards(spark, docs.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("shard=*"))


def test_dealing_equals_key_by_key():
    """Every key of a full shard tries the nodes clockwise, in rounds: all keys try their first node, then those left over the next."""
    rng = np.random.default_rng(9)
    for shards in (2, 3, 8):
        nodes, owners = ring_core.virtual_nodes(shards, 4)
        keys = np.sort(np.r_[rng.integers(-(1 << 63), (1 << 63) - 1, 150), np.full(60, 12345)])
        arcs = ring_core.arcs_of(keys, nodes)
        bounds = ring_core.row_bounds(len(keys), shards)
        room, where, at = list(bounds), [-1] * len(keys), arcs.tolist()
        while -1 in where:
            came = {k: [i for i in range(len(keys)) if where[i] < 0 and at[i] == k] for k in range(len(nodes))}
            for k in range(len(nodes)):
                # those that came from further back on the ring come after the node's own
                for i in sorted(came[k], key=lambda i: ((k - arcs[i]) % len(nodes), i)):
                    if room[owners[k]]:
                        room[owners[k]] -= 1
                        where[i] = int(owners[k])
                    else:
                        at[i] = (k + 1) % len(nodes)
        got = [-1] * len(keys)
        for arc, first, shard, rows in ring_core.deal(np.bincount(arcs, minlength=len(nodes)).tolist(), owners.tolist(), bounds):
            for i in np.flatnonzero(arcs == arc)[first : first + rows]:
                got[i] = shard
        assert got == where and room == [0] * shards


# op10 --------------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, plain):
    stored = media.store_audio(clashing(docs))
    got = media.audio_features(stored).collect()
    want = []
    for d, t in plain:
        p = (t or "").encode()
        p += b"\0" * (64 * max(1, -(-len(p) // 64)) - len(p))
        w = audio_core.wav(p)
        assert audio_core.read_wav(w) == (audio_core.STORED_RATE, p)
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest()))
    assert bag(tuple(r)[:7] for r in got) == bag(want)
    assert len({r.feature for r in got if r.doc_id == 5}) == 1
    assert media.audio_features(media.store_audio(docs.limit(0))).count() == 0


def test_wav_is_readable_by_others(tmp_path):
    import wave

    (tmp_path / "a.wav").write_bytes(audio_core.wav(bytes(range(65))))
    with wave.open(str(tmp_path / "a.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(99)) == (1, 1, audio_core.STORED_RATE, bytes(range(65)))


def test_resampling_keeps_a_tone():
    t = np.arange(12_000) / 12_000
    y = audio_core.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 2, 3)
    both = np.column_stack([f(2 * np.pi * 440 * np.arange(8000) / 8000) for f in (np.sin, np.cos)])[100:-100]  # any delay
    fit, *_ = np.linalg.lstsq(both, y[100:-100], rcond=None)
    assert len(y) == 8000 and np.abs(both @ fit - y[100:-100]).max() < 0.02 and 0.95 < np.hypot(*fit) < 1.05
    high = audio_core.resample(np.sin(2 * np.pi * 5500 * t).astype(np.float32), 2, 3)
    assert np.abs(high[100:-100]).max() < 0.2


def test_segments_have_hysteresis():
    e = np.array([-50, -10, -12, -12, -14, -12, -10, -50], float)
    assert audio_core.segments(e, -11, -13) == [(1, 4), (6, 7)]
    assert audio_core.segments(np.full(3, -12.0), -11, -13) == []


def test_tensors_are_stored_with_their_spans(spark, docs, plain):
    stored, _ = materialise(spark, media.store_audio(clashing(docs)), "test-media")
    rows = stored.collect()
    assert len(rows) == len(plain)
    for r in rows:
        found, table = audio_core.analyse(bytes(r.media)), media.read_tensors(bytes(r.tensors))
        assert table.schema.field("mel").type == media.TENSOR and r.frames == len(found.mel)
        assert np.abs(media.filterbanks(table, r.frames) - found.mel).max() < 0.01
        assert table["mel"].combine_chunks().to_numpy_ndarray().shape == (-(-r.frames // audio_core.PATCH), audio_core.PATCH, audio_core.MELS)
        assert list(zip(table["begin_s"].to_pylist(), table["end_s"].to_pylist(), strict=True)) == found.patch_spans()
        assert [(x.begin_s, x.end_s) for x in r.segments] == found.spans
    patches = media.audio_tensors(stored).collect()
    assert len(patches) == sum(-(-r.frames // audio_core.PATCH) for r in rows) and {len(r.mel) for r in patches} == {audio_core.PATCH * audio_core.MELS}
    assert bag(media.speech_segments(stored).collect()) == bag((r.doc_id, x.begin_s, x.end_s) for r in rows for x in r.segments)
    none = media.store_audio(docs.limit(0))
    assert media.audio_tensors(none).count() == 0 and media.speech_segments(none).count() == 0


def test_audio_features_equal_brute_force():
    rng = np.random.default_rng(6)
    for n in (64, 640, 6400):
        samples = rng.integers(0, 256, n).astype(np.uint8)
        samples[n // 3 : n // 2] = 128
        found = audio_core.analyse(audio_core.wav(samples.tobytes()))
        x = (samples.astype(float) - 128) / 128
        # resampling: zeros between the samples, the whole filter, every third of what comes out
        taps = 16
        t = np.arange(2 * taps) - (2 * taps - 1) / 2
        low = 2 / 3 * np.sinc(t / 3) * np.hamming(2 * taps)
        up = np.zeros(2 * n)
        up[::2] = x
        full = np.convolve(np.r_[up, np.zeros(4 * taps)], low)
        y = np.array([full[3 * m + 2 * (taps - 1 - taps // 2)] for m in range(-(-n * 2 // 3))])
        assert np.allclose(y, audio_core.resample(x.astype(np.float32), 2, 3), atol=1e-4)
        frames = max(1, -(-(len(y) - 200) // 80) + 1)
        y = np.r_[y, np.zeros(frames * 80 + 200)]
        hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), 34) / 2595) - 1)
        for f in range(frames):
            part = y[80 * f : 80 * f + 200]
            power = np.abs(np.fft.rfft(part * np.hanning(200), 256)) ** 2
            for m in range(0, 32, 5):
                a, b, c = hz[m : m + 3]
                weights = [max(0, min((k * 31.25 - a) / (b - a), (c - k * 31.25) / (c - b))) for k in range(129)]
                assert abs(found.mel[f, m] - np.log(np.dot(weights, power) + 1e-6)) < 0.02
            assert abs(found.energy[f] - 10 * np.log10((part**2).mean() + 1e-10)) < 0.02
        on, spans = False, []
        for f, e in enumerate([*found.energy.tolist(), -100.0]):
            if not on and e >= audio_core.OPEN_DB:
                on, first = True, f
            elif on and e < audio_core.CLOSE_DB:
                on = False
                spans.append((first * 0.01, (f - 1) * 0.01 + 0.025))
        assert np.allclose(spans, found.spans)


# pipeline ----------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, real):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).collect()
    rows = [(r.doc_id, r.text) for r in real.collect() if any(c.isalpha() for c in r.text)]
    rows = sorted(brute_kept(rows))
    leaks = [r.text for r in read_table(spark, DATA, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if not any(x in t for x in leaks)]
    import re

    rows = [(d, re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t)) for d, t in rows]
    library = reference_encoding(bpe.production()[0])
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert bag(got) == bag(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]


def test_each_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and Row


def test_keep_first_shuffles_few_texts_of_rows_that_stay(spark, monkeypatch):
    texts = [(k, f"text {k} " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(600)]
    rows = spark.createDataFrame(texts + [(1000 + k, texts[k][1]) for k in range(60)] + [(7, texts[7][1]), (None, None)], "doc_id long, text string")
    want = sorted([*map(tuple, texts), (None, None)], key=str)
    stays = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_first(spark, rows)
        assert sorted(map(tuple, kept.collect()), key=str) == want
        plan = kept._jdf.queryExecution().executedPlan()
        todo, most = [plan], 0
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            elif kind == "ShuffleExchangeExec" and "text#" in node.output().mkString(" "):
                most = max(most, node.metrics().get("shuffleRecordsWritten").get().value())
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
        assert 0 < most < 200
        monkeypatch.setattr(simhash, "SLOTS", 1)  # a bitmap that clears next to nothing loses nothing
        assert sorted(map(tuple, simhash.keep_first(spark, rows).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", stays)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
