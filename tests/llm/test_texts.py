"""Encoding, packing and repair of texts: exact round trips and the public library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from histrank.llm import encoding, packing, tokens
from tests.conftest import rows

SF = "/root/testdata/sf0.01"
PIECES = ["'s", "'re", "'", "s", "re", " ", "  ", "\n", "\t", " ", "　", "a", "é", "1", "²", "½", "!", "…", "日本", "'ll", "'L", "<|endoftext|>", "\r\n", "\x85", "​", "😀", "́", "x'", "''s"]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)] + [None, "", "x" * 50_000, "日本語" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)})
    got = {r["id"]: r["ids"] for r in tokens.encode_texts(df, "id", "text").collect()}
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(got[i] == w.ids for i, w in enumerate(want))
    enc = tokens.encoder()
    assert all(enc.decode(got[i]) == (x or "") for i, x in enumerate(texts))
    assert dict(rows(tokens.count_tokens(df, "id", "text"))) == {i: len(x) for i, x in got.items()}
    assert tokens.encode_texts(df.where("false"), "id", "text").count() == 0


def test_slices_have_offsets():
    texts = ["don't  stop\n\nnow", None, "é 12"]
    enc = tokens.encoder()
    numbers, offsets, firsts = enc.slices(pa.array(texts))
    raw = "".join(t or "" for t in texts).encode()
    ends = np.append(offsets[1:], len(raw))
    assert [raw[a:b].decode() for a, b in zip(offsets, ends)] == ["don", "'t", " ", " stop", "\n", "\n", "now", "é", " 12"]
    assert firsts.tolist() == [0, 7, 7, 9] and len(numbers) == 9


def test_transition_functions_compose():
    functions, then, maps, _ = tokens._automaton()
    rng = random.Random(2)
    for _ in range(500):
        f, g, h = (rng.randrange(len(maps)) for _ in range(3))
        assert then[then[f, g], h] == then[f, then[g, h]]
        assert (maps[then[f, g]] == maps[g][maps[f]]).all()
    symbols = [rng.randrange(tokens.SYMBOLS) for _ in range(2000)]
    state, scan = tokens.TEXT, functions[symbols[0]]
    for i, x in enumerate(symbols):
        state = tokens._step(state, x)
        scan = functions[x] if i == 0 else then[scan, functions[x]]
        assert maps[scan][tokens.TEXT] == state


def test_offsets_decode_any_range(spark):
    texts = ["don't  stop\n\nnow", None, "é 12 日本語😀 we'll", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    enc = tokens.encoder()
    for r in tokens.encode_texts(df, "id", "text", offsets=True).collect():
        raw = (texts[r["id"]] or "").encode()
        assert len(r["ids"]) == len(r["offsets"])
        for a in range(len(raw) + 1):
            for b in range(a, len(raw) + 1):
                assert enc.decode_range(r["ids"], r["offsets"], a, b) == raw[a:b]


@pytest.mark.parametrize(("capacity", "n"), [(10, 60), (7, 3), (2048, 30_000)])
def test_place(capacity, n):
    rng = random.Random(n)
    histogram = {}
    for _ in range(n):
        x = min(capacity, max(1, int(rng.lognormvariate(4.5, 1.3)) if capacity > 100 else rng.randint(1, capacity)))
        histogram[x] = histogram.get(x, 0) + 1
    placements, made = packing.place(histogram, capacity)
    used, seen = {}, {}
    for length, r0, items, c0, copies, offset in placements:
        assert r0 == seen.get(length, 0)
        seen[length] = r0 + items
        for r in range(items):
            used.setdefault(c0 + r // copies, []).append((offset + r % copies * length, length))
    assert seen == histogram and set(used) == set(range(made))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
    if n > 1000:
        assert sum(a * b for a, b in histogram.items()) > 0.99 * made * capacity
    assert packing.place({}, capacity) == ([], 0)


def test_the_shortest_pack_comes_first():
    """Of packs that hold 7 and 5 of 10, an item of 3 goes to the shorter one, by best fit to the longer one."""
    assert packing.place({7: 1, 5: 1, 3: 1}, 10) == ([(7, 0, 1, 0, 1, 0), (5, 0, 1, 1, 1, 0), (3, 0, 1, 1, 1, 5)], 2)
    assert packing.place({7: 1, 5: 1, 3: 1}, 10, fullest=True) == ([(7, 0, 1, 0, 1, 0), (5, 0, 1, 1, 1, 0), (3, 0, 1, 0, 1, 7)], 2)
    assert packing.place({6: 2, 2: 3}, 10) == ([(6, 0, 2, 0, 1, 0), (2, 0, 2, 0, 1, 6), (2, 2, 1, 0, 1, 8)], 2)


def test_pack(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 5, 5, 5, 9, 10, 11, 37, 0, None])) for i in range(500)] + [(9000, 100)]
    df = spark.createDataFrame(data, "id int, n int").withColumns({"piece": F.lit(1), "salt": F.lit(2), "key": F.lit(3)})
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    out = packing.pack(df, "id", "n", 10).collect()
    assert sorted(out) == sorted(packing.pack(df, "id", "n", 10).collect())
    whole = {}
    spans = {}
    for r in out:
        whole.setdefault(r["id"], []).append((r["piece"], r["n_tokens"]))
        spans.setdefault(r["container_id"], []).append((r["container_offset"], r["n_tokens"]))
    for i, n in data:
        got = sorted(whole.get(i, []))
        assert sum(x for _, x in got) == (n or 0) and all(x == 10 for _, x in got[:-1]) and [p for p, _ in got] == list(range(len(got)))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= 10
    assert packing.pack(df.where("false"), "id", "n", 10).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "raw_bytes")


@pytest.fixture(scope="module")
def judge(documents):
    return encoding.Judge(encoding.fit_languages(encoding.sample_texts(documents, "doc_id", "text", "lang")))


@pytest.mark.parametrize(("assumed", "meant"), [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac-roman", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp1253", "utf-8")])
def test_utf8_misread_is_restored(judge, documents, assumed, meant):
    """Clean texts are garbled on purpose and must come back; clean ones must stay."""
    texts = [r["text"] for r in documents.where("text IS NOT NULL AND length(text) < 900").collect() if not r["text"].isascii()]
    clean = [t for t in texts if judge.restore(t)[1] == [] and "�" not in t]
    garbled = [(t, "".join(encoding._BYTES.get(assumed, {b: chr(b) for b in range(256)}).get(b, chr(b)) if assumed != "latin-1" else chr(b) for b in t.encode(meant))) for t in clean[:150]]
    found = [(t, judge.restore(g)) for t, g in garbled]
    assert len(clean) > 0.85 * len(texts)
    assert np.mean([bool(used) for _, (_, used) in found]) > 0.97
    assert np.mean([again == t for t, (again, _) in found]) > 0.75


@pytest.mark.parametrize(("lang", "assumed", "meant"), [("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8-r"), ("el", "cp1252", "cp1253"), ("cs", "cp1252", "cp1250"), ("pl", "cp1252", "iso8859-2"), ("tr", "cp1252", "cp1254"), ("fr", "cp437", "cp1252")])
def test_single_byte_misreading_is_found(judge, documents, lang, assumed, meant):
    texts = [r["text"] for r in documents.where(f"lang = '{lang}' AND length(text) < 900").collect()]
    seen = n = 0
    for t in texts:
        try:
            g = "".join(encoding._BYTES[assumed].get(b, chr(b)) for b in t.encode(meant))
        except UnicodeEncodeError:
            continue
        if g == t or judge.restore(t)[1]:
            continue
        n += 1
        seen += bool(judge.restore(g)[1])
    assert n >= 3 and seen >= 0.95 * n


def test_unlisted_words_are_weighed(judge):
    """A misread word that no list knows is found; with a neighbour that tells which reading is meant it is restored."""
    word = "Экзистенциалистские"
    garbled = word.encode("koi8-r").decode("cp1251")
    assert word.lower() not in judge.known
    assert judge.restore(garbled)[1] and judge.restore(word)[1] == []
    line = "В этом году " + word + " вопросы и ответы"
    again, used = judge.restore(line.encode("koi8-r").decode("cp1251"))
    assert again == line and used == ["cp1251:koi8-r"]


def test_chains_of_any_depth(judge):
    text = x = "Größe und Länge für alle Räume"
    for _ in range(5):
        x = x.encode("utf-8").decode("latin-1")
    assert judge.restore(x)[0] == text


def test_the_page_tells(judge):
    """A passage that the page's bytes don't hold, while they hold its candidate, was misread."""
    page = "<html><p>Übergrößenträger</p><p>Über Größe und Länge für alle Räume</p></html>".encode("cp1252")
    garbled = "Übergrößenträger".encode("cp1252").decode("cp1253", "replace").replace("\ufffd", "")
    again, used = judge.restore(garbled, page)
    assert used and judge.restore("Übergrößenträger", page)[1] == []


def test_find_garbled(spark, documents):
    extra = [(-1, None, "fr", None), (-2, "", None, b""), (-3, "plain", "xx", None), (-4, "l�ger", "fr", "<p>léger</p>".encode("cp1252")), (-5, "CafÃ© " * 20_000, "en", None)]
    df = documents.unionByName(spark.createDataFrame(extra, documents.schema)).withColumns({"chains": F.lit(1), "restored": F.lit(2), "h": F.lit(0), "l": F.lit(0)})
    out = {r["doc_id"]: r for r in encoding.find_garbled(df, "doc_id", "text", "lang", page="raw_bytes").collect()}
    assert not {-1, -2, -3} & set(out)
    assert out[-4]["restored"] == "léger" and out[-4]["chains"] == ["lost"]
    assert out[-5]["restored"] == "Café " * 20_000
    assert encoding.find_garbled(df.where("false"), "doc_id", "text", "lang").count() == 0


def test_all_texts_are_fitted(spark):
    """Words, lines and thresholds come from all texts of a language, wherever they stand and however many there are."""
    n = 1200
    text = F.when(F.col("id") % 4 == 0, "Straßenbahnführer fahren").otherwise("Haltestelle überall")
    text = F.when(F.col("id") < 5, "Seltenwörtchen").otherwise(text)  # 5 texts of 1,200 are below the share
    text = F.concat(text, F.lit("\n"), F.concat(F.lit("Zeile "), (F.col("id") % 300).cast("string")))
    df = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("DE-xx").alias("lang"))
    late = df.withColumn("h", F.xxhash64("doc_id")).orderBy("h").withColumn("late", F.monotonically_increasing_id() >= 500)  # beyond the former sample
    df = late.withColumn("text", F.when(F.col("late"), F.concat("text", F.lit("\nVorübergehend gesperrt"))).otherwise(F.col("text")))
    found = encoding.fit_languages(encoding.sample_texts(df, "doc_id", "text", "lang"))
    assert {"straßenbahnführer", "überall", "vorübergehend"} <= found.words["de"] and "seltenwörtchen" not in found.words["de"]
    lines = found.dictionaries["de"].decode().split("\n")
    assert {f"Zeile {i}" for i in range(300)} <= set(lines)
    at = [lines.index(x) for x in ("Vorübergehend gesperrt", "Haltestelle überall")]
    assert at == sorted(at) and at[0] > lines.index("Zeile 0")  # the more texts hold a line, the nearer it is to the end
