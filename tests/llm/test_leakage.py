import random

import numpy as np

from tarnwheel.llm import leakage as L

from ..conftest import rows

DOCS, ITEMS = "d bigint, text string, item string, longest int", "i bigint, q string, lang string, doc string"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], DOCS)
    t = spark.createDataFrame([(*x, "z") for x in items], ITEMS)
    return L.leaks(d, "d", "text", t, "i", "q", "lang", **kw)


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        t = rng.integers(0, 3, n)
        sa = L.suffix_array(t, n + 1)
        assert sorted(range(n), key=lambda i: tuple(t[i:])) == list(sa)


W = [f"w{i}" for i in range(60)]


def brute(docs, items, n=4):
    out = []
    for d, t in docs:
        dw = L.regex.findall(L.WORD, L.folded(t or ""))
        for i, q, _ in items:
            iw = L.regex.findall(L.WORD, L.folded(q or ""))
            best = 0
            for a in range(len(iw)):
                for b in range(len(dw)):
                    k = 0
                    while a + k < len(iw) and b + k < len(dw) and iw[a + k] == dw[b + k]:
                        k += 1
                    best = max(best, k)
            if iw and best >= min(n, len(iw)):
                out.append((d, i, best))
    return sorted(out)


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choices(W[:8], k=rnd.randrange(2, 14))), "en") for i in range(12)]
    docs = [(d, " ".join(rnd.choices(W[:8], k=rnd.randrange(0, 60)))) for d in range(40)]
    got = rows(run(spark, docs, items, min_words=4, shard_tokens=100), "d", "i", "longest")
    assert got == brute(docs, items)
    assert got == rows(run(spark, docs, items, min_words=4, block_chars=60), "d", "i", "longest")


def test_folding_short_items_and_scripts(spark):
    zh = "早上技师布佐贾万斯在办公室外称了木箱因为菲基维内伦还要七万八千个"
    items = [(1, "The CAFÉ, opened!", "fr"), (2, zh, "zh"), (3, "", "en"), (4, None, "en"), (5, "only two", None)]
    docs = [(1, "x the café — opened y"), (2, "开头，" + zh[:26] + "。"), (3, "开头" + zh[:25] + "。"), (4, None), (5, ""), (6, "ｏｎｌｙ ｔｗｏ"), (None, "only two")]
    assert rows(run(spark, docs, items), "d", "i") == [(1, 1), (2, 2), (6, 5)]


def test_passages_do_not_run_across_documents_or_items(spark):
    w = W[:24]
    docs = [(1, " ".join(w[:6])), (2, " ".join(w[6:12])), (3, " ".join(w[6:18]))]
    items = [(1, " ".join(w[:12]), "en"), (2, " ".join(w[12:24]), "en")]
    assert rows(run(spark, docs, items), "d", "i") == []


def test_long_repetitive_text_and_repeats(spark):
    docs = [(1, "a " * 50_000), (2, "b"), (2, "b")]
    items = [(1, "a " * 40, "en"), (1, "a " * 40, "en"), (2, "b", "en")]
    assert rows(run(spark, docs, items), "d", "i", "longest") == [(1, 1, 40), (2, 2, 1)]


def test_matches_in_parts_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    items = L.Items([(i, " ".join(rng.choice(["a", "b"], 9))) for i in range(6)], L.WORD, 3)
    shard = L._Shard("words", 3)
    shard.add(1, " ".join(rng.choice(["a", "b", "c"], 500)))
    b = shard.row()
    vocabulary, tokens, sa = (np.frombuffer(b.column(k)[0].as_py(), t) for k, t in ((3, "<i8"), (4, "<i4"), (5, "<i4")))
    whole = [np.concatenate(x) for x in zip(*items.search(tokens, sa, vocabulary))]
    monkeypatch.setattr(L, "MATCHES", 40)
    parts = list(items.search(tokens, sa, vocabulary))
    assert len(parts) > 5 and sorted(map(tuple, np.stack(whole, 1))) == sorted(map(tuple, np.stack([np.concatenate(x) for x in zip(*parts)], 1)))


def test_shards_are_written_once_and_searched_often(spark, tmp_path):
    docs = [(d, f"w1 w{d} w2 w3 w{d % 3} w5") for d in range(50)] + [(90, "早上技师在办公室外称了木箱")]
    df = spark.createDataFrame([(*x, "z", 1) for x in docs], DOCS)
    L.suffix_shards(df, "d", "text", shard_tokens=60).write.parquet(f"{tmp_path}/shards")
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert stored.where("kind = 'words'").count() > 3
    for items in ([(1, "w2 w3 w1", "en"), (2, "技师在办公室", "zh")], [(3, "w7 w2", "en")]):
        t = spark.createDataFrame([(*x, "z") for x in items], ITEMS)
        got = rows(L.search(lambda k: stored.where(f"kind = '{k}'"), t, "i", "q", "lang"), "doc", "item", "longest")
        assert got == rows(run(spark, docs, items), "d", "i", "longest") and got


def test_clean_documents_and_empty_tables(spark):
    items = [(1, "b", "en")]
    d = spark.createDataFrame([(1, "a", "", 0), (2, "b", "", 0)], DOCS)
    assert rows(L.without_leaks(d, "d", run(spark, [(1, "a"), (2, "b")], items)), "d") == [(1,)]
    assert run(spark, [], items).count() == 0 and run(spark, [(1, "a")], []).count() == 0


def test_passages_of_character_items_without_han_or_kana(spark):
    latin, hangul = "Abcdefghijklm nopqrstuvwxyz0", "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"
    items = [(1, "他说 " + latin + " 早", "zh"), (2, "見" + hangul, "ja"), (3, "Run7!", "zh"), (4, "早ab" * 20, "zh")]
    docs = [(1, "x, " + latin[:27].upper() + "."), (2, "x " + latin[:26]), (3, hangul[:26]), (4, hangul[:25]), (5, "so run 7 it"), (6, "ab" * 40)]
    assert rows(run(spark, docs, items), "d", "i") == [(1, 1), (3, 2), (5, 3)]
    assert not L.Items([(4, "早ab" * 20)], L.SYMBOL, 26).narrow
