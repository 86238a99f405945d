import random

import numpy as np

from tidemark.llm import leakage, packing, truncation

VOCAB = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60)]


def passages(rng, n=40):
    return [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(30, 90)))) for i in range(n)]


def spoilt(rng, ws, rate):
    out = []
    for w in ws:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice(VOCAB) if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(rng.choice(VOCAB))
    return out


def leak_table(rng, items):
    docs = []
    for d in range(150):
        filler = [rng.choice(VOCAB) for _ in range(rng.randrange(20, 120))]
        if d % 3 == 0:
            ws = rng.choice(items)[1].split()
            at = rng.randrange(0, max(1, len(ws) - 25))
            filler[10:10] = spoilt(rng, ws[at : at + rng.choice([8, 14, 20, 24, 40, 90])], rng.choice([0, 0.05, 0.12]))
        docs.append((d, " ".join(filler)))
    return docs


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = passages(rng)
    docs = leak_table(rng, items) + [(900, None), (901, ""), (None, items[0][1]), (902, "pad " * 30_000 + items[1][1]), (903, items[2][1].upper().replace(" ", ",\n> ")), (903, items[2][1])]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items + [(77, None), (78, "too short"), (items[0])], "item_id bigint, text string")
    find = lambda **kw: {tuple(r) for r in leakage.find(d, "doc_id", "text", i, "item_id", "text", **kw).collect()}
    got = find()
    assert got == find(brute=True) and {(902, 1), (903, 2)} <= got and 20 < len(got) < 120
    assert find(block_bytes=2_000) == got == find(block_bytes=700, blocks_a_pass=2)
    assert leakage.find(d.where("false"), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.find(d, "doc_id", "text", i.where("false"), "item_id", "text").count() == 0


def test_wand_equals_exhaustive_scores():
    rng = random.Random(8)
    ix = leakage.Index(passages(rng, 300))
    for _ in range(60):
        q = sorted(rng.sample(range(len(ix.terms)), 40))
        scores: dict[int, float] = {}
        for t in q:
            for n, s in zip(ix.docs[t], ix.scores[t]):
                scores[n] = scores.get(n, 0.0) + s
        for threshold in (0.3, 0.6, 1.0):
            assert set(ix.above(q, threshold)) == {n for n, s in scores.items() if s >= threshold}


def leaks_by_hand(item, text):
    """Cell by cell: stretches whose first and last word are held, for each place to begin."""
    for a in range(len(item) - 19):
        row = [0 if j and text[j - 1] == item[a] else 999 for j in range(len(text) + 1)]
        for j in range(1, len(row)):
            row[j] = min(row[j], row[j - 1] + 1)
        for n, w in enumerate(item[a + 1 :], 2):
            if n >= 20 and any(6 * row[j] <= n for j, v in enumerate(text) if v == w):
                return True
            diag, row[0] = row[0], row[0] + 1
            for j, v in enumerate(text, 1):
                diag, row[j] = row[j], min(diag + (w != v), row[j] + 1, row[j - 1] + 1)
    return False


def test_alignment_equals_all_stretches():
    rng = random.Random(12)
    found = 0
    for _ in range(60):
        item = [rng.choice(VOCAB) for _ in range(rng.randrange(20, 90))]
        text = [rng.choice(VOCAB) for _ in range(6)] + spoilt(rng, item[: rng.randrange(14, 90)], rng.choice([0.05, 0.12, 0.2])) + [rng.choice(VOCAB) for _ in range(6)]
        number = {w: i for i, w in enumerate(VOCAB)}
        got = leakage.aligned(np.array([number[w] for w in item]), np.array([number[w] for w in text]), 20, 6)
        assert got == leaks_by_hand(item, text)
        found += got
    assert 5 < found < 55


def lost(items, docs):
    ix = leakage.Index(items)
    want = {(d, i) for d, t in docs for i in leakage._leaks(ix, leakage.words(t), 96, True)}
    got = {(d, i) for d, t in docs for i in leakage._leaks(ix, leakage.words(t), 96)}
    return want, got


def test_no_link_is_lost_in_long_items():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(160)] + [(160, " ".join(rng.choice(vocab) for _ in range(2400)))]
    long, docs = items[-1][1].split(), []
    for d in range(16):
        at = rng.randrange(2380)
        quote = long[at : at + 20]
        for k in rng.sample(range(1, 19), 3 if d % 2 else 0):
            quote[k] = "zz"
        docs.append((d, " ".join([*(rng.choice(vocab) for _ in range(50)), *quote, *(rng.choice(vocab) for _ in range(50))])))
    want, got = lost(items, docs)
    assert got == want and {(d, 160) for d in range(16)} <= got


def test_no_link_is_lost_in_shared_or_repetitive_passages():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(900)]
    common, everywhere = ([rng.choice(vocab) for _ in range(30)] for _ in range(2))
    items = [(i, " ".join([*(rng.choice(vocab) for _ in range(40)), *(common if i % 5 else []), *everywhere, *(rng.choice(vocab) for _ in range(20))])) for i in range(100)]
    items += [(200, " ".join(["la", "di"] * 40)), (201, "hey " * 50)]
    docs = [(0, " ".join(common)), (1, " ".join(["x", *everywhere[:24], "y"])), (2, " ".join(["la", "di"] * 12)), (3, "hey " * 21), (4, items[7][1]), (5, "hey " * 15)]
    want, got = lost(items, docs)
    assert got == want
    of = lambda d: {i for e, i in got if e == d}
    assert len(of(0)) == 80 and len(of(1)) == 100 and of(2) == {200} and of(3) == {201} and 7 in of(4) and not of(5)


def test_markup_does_not_count():
    plain = leakage.words("The silver groundsman copied a banner")
    for t in ("THE <b>silver</b>\n> grounds-\n> man, copied a&nbsp;banner!", "the silvér GROUNDSMAN  **copied** a ban​ner"):
        assert leakage.words(t) == plain


def test_condition_of_an_alignment():
    a = np.arange(40)
    hold = lambda t, least=20: leakage.aligned(a, np.array(t), least, 6)
    assert hold(range(10, 30)) and not hold(range(10, 29)) and not hold([])
    changed = list(range(10, 34))
    for k in (4, 10, 16, 20):
        changed[k] = 99
    assert hold(changed)  # 4 of 24
    changed[7] = changed[13] = 99
    assert not hold(changed)
    assert hold([*range(0, 10), 99, 98, *range(10, 25)]) and hold([*range(0, 12), *range(14, 30)])
    assert leakage.sure_run(20, 6) == 4


def test_fill_respects_limits_and_is_whole():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 900, 3000)
    loss = (t * rng.random(3000)).astype(int)
    lim = packing.Limits(tokens=1000, segments=5, loss=600)
    loss = np.minimum(loss, 600)
    c = packing.fill(t, loss, lim)
    assert (c >= 0).all()
    for n in range(c.max() + 1):
        own = c == n
        assert own.any() and t[own].sum() <= 1000 and own.sum() <= 5 and loss[own].sum() <= 600
    full = packing.fill(t, t, packing.Limits(1000, 50, 1000))
    assert full.max() + 1 <= 1.01 * np.ceil(t.sum() / 1000)


def test_packed(spark):
    words = lambda n: " ".join(["goal"] * n)
    rows = [(1, words(5)), (2, ""), (3, None), (4, "Instruction\n" + words(9)), (5, words(5000)), (6, words(5)), (6, words(5)), (None, words(3))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, container int")
    out = packing.packed(df, "doc_id", "text").collect()
    by = {d: sorted((r["piece"], r["first_token"], r["n_tokens"], r["n_loss"]) for r in out if r["doc_id"] == d) for d in (1, 2, 4, 5, 6)}
    assert len(out) == 5 + 3 and by[2] == [(0, 0, 0, 0)] and [p[:3] for p in by[5]] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and len(by[6]) == 2
    assert by[4][0][2] > by[4][0][3] > 0
    totals: dict[int, int] = {}
    for r in out:
        totals[r["container"]] = totals.get(r["container"], 0) + r["n_tokens"]
    assert max(totals.values()) <= 2048
    assert packing.packed(df.where("false"), "doc_id", "text").count() == 0


def test_rounds_place_everything_once(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, 0, 0, n := rng.randrange(1, 1500), n) for i in range(3000)], "doc_id bigint, piece int, first_token bigint, n_tokens bigint, n_loss bigint")
    out = packing.pack(df, "doc_id", packing.Limits(2048, 64, 2048), group_items=400).toPandas()
    assert sorted(out.doc_id) == list(range(3000)) and out.groupby("container").n_tokens.sum().max() <= 2048
    assert out.container.nunique() <= 1.03 * df.toPandas().n_tokens.sum() / 2048


def test_texts_are_divided_by_tokens_only(spark):
    s = spark.createDataFrame([(1, 3000, 2500), (2, 1500, 0)], "doc_id bigint, n_tokens bigint, n_prompt bigint")
    out = packing.pieces(s, "doc_id", packing.Limits(2048, 64, 1000)).collect()
    got = {d: sorted((r["first_token"], r["n_tokens"], r["n_loss"]) for r in out if r["doc_id"] == d) for d in (1, 2)}
    assert got == {1: [(0, 2048, 0), (2048, 952, 500)], 2: [(0, 1500, 1500)]}


def test_an_item_of_more_loss_than_the_limit_stands_without_others():
    t, loss = np.array([900, 300, 200, 100, 100]), np.array([900, 300, 200, 0, 100])
    c = packing.fill(t, loss, packing.Limits(1000, 9, 600))
    assert c[0] == c[3] and c[1] == c[2] == c[4] != c[0]
    assert len(packing.fill(np.array([], dtype=int), np.array([], dtype=int), packing.Limits())) == 0


WHOLE = [
    "It ended well.", "Was it? « Yes. »", 'He said "never in doubt".', "Fine.\n— Kepor Nitan, push alerts", "Fine.\n#Foo #Bar", "Fine.\nTags: odds, Foo", "Fine.\nFoo Town 2-1 Bar City", "Fine.\nMore follows", "Fine.\nÀ suivre…",
    "Fine.\n⚽🔥", "Fine.\n+++", "Fine.\n(ends)", "Fine.\nKick-off 20:45", "Fine. <b>bold.</b>", "| A | 1 |\n| B | 2 |", "- A v B: 2.61 / 3.02 / 1.31", "[ok] X : 3 matchs", "Fine.  \n", "Fine.\nlol",
]
CUT = [
    "It ended we", "It ended and ", "The closing price on Orlaufis… [+241 chars]", "the second goal in [...]", "set up the g…", "It was\n- A v B: 2.61 / 3.", "| A | 1 |\n| B |", "[ok] X : 3", "bytes cut �", "Fine.\nKick-off 20",
    "Fine.\n— Kepor Nitan, push al", "Foo Townsend played.\n#Foo #Towns", "Score: 1.2, and then", "An open <b", "Coming from th...",
]


def test_ends(spark):
    frame = [f"| A | {i} |\n| B | {i} |" for i in range(5)] + [f"- A v B: 2.{i}1 / 3.02 / 1.31\n- C v D: 2.61 / 3.02 / 1.31" for i in range(5)] + [f"[ok] X : {i} matchs\n[ok] Y : 1 matchs" for i in range(5)]
    rows = [(t, "push_alerts", None) for t in WHOLE + CUT + frame + [None, "", "   "]]
    df = spark.createDataFrame(rows, "text string, source string, cut string")
    out = {r["text"]: (r["cut"], r["evidence"]) for r in truncation.ends(df, "text", "source").collect()}
    assert [t for t in WHOLE if out[t][0] is not False] == [] and [t for t in CUT if out[t][0] is not True] == []
    assert out[None] == (None, None) and out[""] == (None, None)
    assert truncation.ends(df.where("false"), "text", "source").count() == 0


def limits_of(spark, rows):
    return {(r["source"], r["unit"]): r["length"] for r in truncation.limits(spark.createDataFrame(rows, "text string, source string"), "text", "source").collect()}


def test_stages(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc de") for _ in range(150)) + "a", "s", None) for _ in range(30)] + [("b" * n, "s", None) for n in range(60, 90)] + [("Done." + "c" * 145 + ".", "s", None)]
    out = truncation.ends(spark.createDataFrame(rows, "text string, source string, stage string"), "text", "source").groupBy("stage").count().collect()
    assert {r["stage"]: r["count"] for r in out} == {"length_spike": 30, "text_end": 30, None: 1}


def test_limits_are_found(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        t = "".join(rng.choice("ab é") for _ in range(rng.randrange(20, 300)))
        rows.append((t[:100], "chars")) if i % 2 else rows.append((t.encode()[:120].decode("utf-8", "ignore"), "bytes"))
    rows += [("x" * rng.randrange(20, 300), None) for _ in range(100)]
    out = {(r["source"], r["unit"]): r["length"] for r in truncation.limits(spark.createDataFrame(rows, "text string, source string"), "text", "source").collect()}
    reposted = limits_of(spark, [("x" * 77, "r")] * 50 + [("y" * 77 + f"{i % 3}", "r") for i in range(50)])
    assert reposted == {}
    marked = limits_of(spark, [("".join(rng.choice("abc d") for _ in range(150)) + m, "m") for m in ("…", " [+41 chars]", "", "... [+7 chars]") for _ in range(4)])
    assert {k: v for k, v in marked.items() if k[1] == "chars"} == {("m", "chars"): 150}
    assert out["chars", "chars"] == 100 and out["bytes", "bytes"] == 120 and (None, "chars") not in out


