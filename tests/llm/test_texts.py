"""Leaks, mixtures and residue on small collections."""

import math
import os
import random

import numpy as np
import pytest

from helixmill.llm import leakage, mixing, queries, residue
from tests.oracle import DATA

DOCS = "doc_id long, text string, source string, item_id long, tokens long, place long, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 5, 5, 5, "clash") for r in rows], DOCS)


def _vocabulary(rng, n=3000):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    words = _vocabulary(rng)
    pick = lambda n: [words[min(int(rng.expovariate(0.004)), 2999)] for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([5, 8, 12, 13, 40, 60]))), rng.choice(["B", None, ""]), "x") for i in range(40)] + [(90, None, None, "x"), (91, "", "A", "x"), (92, "...", None, "x"), (0, "again", None, "x")]
    texts = []
    for d in range(300):
        w = pick(rng.randrange(0, 200))
        if d % 3 == 0:
            it = items[rng.randrange(40)][1].split()
            a = rng.randrange(0, max(1, len(it) - 12))
            part = it[a : a + rng.choice([11, 12, 13, 30])]
            part[0] = part[0].upper() + ","
            p = rng.randrange(0, len(w) + 1)
            w[p:p] = ["''" + x + "''" if rng.random() < 0.2 else x for x in part]
        texts.append((d, " ".join(w), "s"))
    texts += [(1000, None, "s"), (1001, "", None), (None, "lost", "s"), (1002, items[5][1] * 2, None), (1002, items[5][1] * 2, None), (1003, " ".join(pick(30000)) + " " + items[6][1] + " " + " ".join(pick(30000)), "s")]
    it = spark.createDataFrame(items, "item_id long, text string, answer string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs(spark, texts), it).where("kind = 'verbatim'").collect()}
    want = set()
    for d, t, _ in texts:
        w = leakage.words(t)
        for i, x, *_ in items[:-1]:
            q = leakage.words(x)
            n = min(12, len(q))
            if d is not None and n and {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
                want.add((d, i))
    assert len(want) > 40 and got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string, answer string")
    assert leakage.leaks(docs(spark, [(1, "a b", "s")]), none).count() == 0
    some = spark.createDataFrame([(1, "alpha beta", None)], "item_id long, text string, answer string")
    assert leakage.leaks(docs(spark, []), some).count() == 0


def test_blocks_of_items_agree(spark):
    items = spark.createDataFrame([(i, f"w{i} v{i} u{i} same words here w{i + 1} and more {i}", None) for i in range(30)], "item_id long, text string, answer string")
    d = docs(spark, [(i, f"xx w{i} v{i} u{i} same words here w{i + 1} and more {i} yy", "s") for i in range(0, 30, 2)])
    one, many = leakage.leaks(d, items), leakage.leaks(d, items, leakage.LeakOptions(passages=40))
    assert set(map(tuple, one.select("doc_id", "item_id").collect())) == set(map(tuple, many.select("doc_id", "item_id").collect())) == {(i, i) for i in range(0, 30, 2)}


def test_disguised_items_are_found(spark):
    """Items with words replaced, swapped and dropped, planted in documents that hold their answer. cosine and paraphrase were chosen on the
    items with even ids of another draw; here those with odd ids are looked for."""
    rng = random.Random(6)
    folder = f"{os.path.dirname(DATA)}/sf0.01"
    items = [(r.item_id, r.text, r.answer) for r in spark.read.parquet(f"{folder}/eval_items.parquet").where("text is not null").collect()]
    hosts = [(r.doc_id, leakage.words(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").limit(400).collect()]  # a small fixture
    vocabulary = [w for _, t in hosts for w in t]
    rows, want = [], set()
    for n, (i, text, answer) in enumerate(x for x in items if x[0] % 2 and len(leakage.words(x[1])) >= 20):
        w = [rng.choice(vocabulary) if rng.random() < 0.18 else x for x in leakage.words(text) if rng.random() > 0.05]
        for k in range(0, len(w) - 1, 7):
            w[k], w[k + 1] = w[k + 1], w[k]
        h = hosts[n][1] + ([answer.lower()] if answer else [])
        rows.append((n, " ".join(h[: len(h) // 2] + w + h[len(h) // 2 :]), "s"))
        want.add((n, i))
    rows += [(10_000 + d, " ".join(w), "s") for d, w in hosts]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()}
    hidden = {p for p in want if got.get(p) != "verbatim"}
    assert len(hidden) > 60 and sum(got.get(p) == "paraphrase" for p in hidden) >= 0.9 * len(hidden), (len(hidden), sum(got.get(p) == "paraphrase" for p in hidden))
    assert sum(k == "paraphrase" for p, k in got.items() if p not in want and p[0] < 10_000) <= 0.05 * len(want)


def test_the_index_against_brute_force(spark):
    """Of all windows and passages with a cosine over the threshold the cells probed hold nearly all, and every one with the same words."""
    folder = f"{os.path.dirname(DATA)}/sf0.01"
    table, opts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), leakage.LeakOptions()
    block = next(leakage.item_blocks(spark.read.parquet(f"{folder}/eval_items.parquet"), opts))
    m = leakage.fit(table, block, opts)
    m.vectors = m.vectors.astype(np.float32)
    texts = [leakage.words(r.text) for r in table.where("text is not null").collect()]
    found, whole = leakage.candidates(texts, m, opts), leakage.candidates(texts, m, leakage.LeakOptions(probes=10**6))
    pairs = [{x for x in zip(*(a.tolist() for a in c[:3]))} for c in (found, whole)]
    same = [{x for x, s in zip(zip(*(a.tolist() for a in c[:3])), c[4]) if s} for c in (found, whole)]
    assert len(same[1]) > 100 and same[0] == same[1]
    assert len(pairs[1]) > 1000 and pairs[0] <= pairs[1] and len(pairs[0]) >= 0.9 * len(pairs[1]), (len(pairs[0]), len(pairs[1]))


def test_subsequence_and_svd(spark):
    assert leakage.common_subsequence("a b c d e".split(), "x a c y d z e".split()) == 4
    rng = np.random.default_rng(0)
    a = (rng.random((60, 6)) @ rng.random((6, 40))).astype(np.float32)
    rows = spark.createDataFrame([(list(range(40)), [float(x) for x in r]) for r in a], "ids array<int>, weights array<float>")
    v = leakage.randomised_svd(rows, 40, 6, 8, 2, 1)
    assert np.abs(a - a @ v @ v.T).max() < 1e-2


def test_weights():
    w, t, b = mixing.target_weights([100, 1000, 10, 0], [0.5, 0.3, 0.2, 0.0], [1, 1, 4, 2])
    assert np.allclose(w, [0.5, 0.3, 0.2, 0]) and t == 1 and math.isclose(b, 200)
    w, t, b = mixing.target_weights([100, 1000, 10], [0.5, 0.3, 0.2], [1, 1, 4], budget=600)
    assert 0 < t < 1 and b == pytest.approx(600) and (w * b <= np.array([100, 1000, 40]) + 1e-6).all()
    assert mixing.target_weights([0, 0], [0.5, 0.5], [1, 1])[2] == 0
    w, t = mixing.temperature_weights([0.7, 0.2, 0.1], 1.0)
    assert mixing.entropy(w) == pytest.approx(1.0, abs=1e-6) and 0 < t < 1


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), "abc"[min(2, int(rng.expovariate(1.2)))]) for i in range(3000)] + [(9000, None, "a"), (9001, "", "a"), (9002, "text", None), (9003, "text", "unknown"), (None, "text", "a")]
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.15, 3), ("empty", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    path, opts = queries.tokenizer(), mixing.MixOptions(last=16, block=2000)
    draw, report = mixing.mix(docs(spark, rows), t, path, opts)
    got = {r["source"]: r for r in report.collect()}
    used = draw.toPandas()
    assert set(used.source) <= {"a", "b", "c"} and not used.duplicated(["doc_id", "round"]).any()
    for s, aim in (("a", 0.4 / 0.95), ("b", 0.4 / 0.95), ("c", 0.15 / 0.95)):
        assert abs(got[s]["share"] - aim) < 0.01
        mine = used[used.source == s]
        assert mine.tokens.sum() == got[s]["drawn"] and mine.groupby("doc_id").size().max() == got[s]["most_repeats"] <= {"a": 1, "b": 2, "c": 3}[s]
        for _, one in mine.groupby("round"):
            assert set(one.block) == set(range(one.block.max() + 1))
        # any half of the mix has about the share too
        half = used[used.turn < 0.5]
        assert abs(half[half.source == s].tokens.sum() / half.tokens.sum() - aim) < 0.05
    assert got["empty"]["drawn"] == 0 and used.turn.between(0, 1).all() and used.block.nunique() > 4
    again, _ = mixing.mix(docs(spark, rows), t, path, opts)
    assert again.toPandas().sort_values("turn").doc_id.tolist() == used.sort_values("turn").doc_id.tolist()
    for options in (mixing.MixOptions(), mixing.MixOptions(of_all=0.9), mixing.MixOptions(even=0.8)):
        nothing, report = mixing.mix(docs(spark, []), t, path, options)
        assert nothing.count() == 0 and report.count() == 4
    assert mixing.mix(docs(spark, rows[:5]), t.limit(0), path)[0].count() == 0


@pytest.mark.parametrize("kind", queries.MIXES)
def test_shares_reach_the_weights(spark, kind):
    """On the test tables: every source within one document of its weight, no document too often, the exponent bisected where it binds."""
    table = spark.read.parquet(f"{DATA}/mix_targets.parquet")
    draw, report = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet"), table, queries.tokenizer(), queries.MIXES[kind])
    limit = {r["source"]: r["max_repeats"] for r in table.collect()}
    rows, used = report.collect(), draw.toPandas()
    total = sum(r["drawn"] for r in rows)
    longest = used.groupby("source").tokens.max()
    for r in rows:
        assert r["most_repeats"] <= limit[r["source"]] and r["drawn"] == used[used.source == r["source"]].tokens.sum()
        if r["drawn"]:
            assert abs(r["drawn"] - r["weight"] * total) <= longest[r["source"]] + longest.sum() * r["weight"]
    t = rows[0]["exponent"]
    shares = np.array([r["tokens"] for r in rows]) / sum(r["tokens"] for r in rows)
    weights = np.array([r["weight"] for r in rows])
    if kind == "targets":
        aim = np.array([r["target_share"] * (r["tokens"] > 0) for r in rows])
        assert t == 1 and np.allclose(weights, aim / aim.sum())
    elif kind == "budget":
        assert 0 < t < 1 and any(r["drawn"] >= 0.99 * limit[r["source"]] * r["tokens"] for r in rows if r["tokens"])
    else:
        there = shares > 0
        assert t < 1 and np.allclose(weights[there], shares[there] ** t / (shares[there] ** t).sum(), atol=1e-6) and mixing.entropy(weights) == pytest.approx(0.8 * np.log(there.sum()), abs=1e-6)


def test_residue(spark):
    rng = random.Random(3)
    words = _vocabulary(rng, 400)
    prose = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(6)) + ".\n"
    bad = [
        "The {{{title}}} lies in {{{region|}}}.", "In ${page.year} it was founded.", "Welcome to %AUTHOR%, the %RIVER% of the month.", "He was born on [date of birth] in [place].", "Please see [insert district here].", "{{subst:PAGENAME}} ({{subst:CURRENTYEAR}})",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod", "Your text here. Your text here. Your text here.", "Error 503: service unavailable\nPlease try again in a few minutes.", "You need to enable JavaScript to run this app.", "Checking your browser before you proceed...",
        "It was named by undefined in NaN, see [object Object].",
    ]
    good = [
        'A notice reading "please enable cookies and scripts" is no consent.', "<nowiki>{{{population|}}}</nowiki> shows the number.", '<syntaxhighlight lang="sh">echo "${name}"</syntaxhighlight>', "The album ''Page Not Found'' came out in 1998.", "{{Infobox river\n| name = \n| length = \n}}",
        "{{citation needed|date=May 2011}}", "The error was 27% of the value [1], see [note 3].", "",
    ]
    rows = [(i, prose() + b + "\n" + prose(), "s") for i, b in enumerate(bad)] + [(100 + i, prose() + g + "\n" + prose(), "s") for i, g in enumerate(good)]
    rows += [(2000 + i, prose(), "s") for i in range(800)] + [(500, None, "s"), (501, "", None), (None, bad[0], "s"), (502, bad[0], "s"), (502, bad[0], "s"), (503, "#REDIRECT [[{{{x}}}]]", "s"), (504, prose() * 400 + bad[7], "s"), (505, bad[9], "s")]
    got = {r["doc_id"] for r in residue.residue(docs(spark, rows)).collect()}
    assert got == set(range(len(bad))) | {502, 504, 505}
    assert residue.residue(docs(spark, [])).count() == 0


def test_residue_in_other_words(spark):
    """Residue worded as none of the seeds, in prose of a real collection; and prose about such things."""
    unseen = [
        "Traceback (most recent call last):\n  File \"render.py\", line 88, in build\nZeroDivisionError: division by zero", "Welcome to [Company Name], founded in [Year].", "Visit ##WEBSITE## for more.", "Dear {{ customer.first_name }}, your order has shipped.", "Per visualizzare la pagina occorre abilitare JavaScript.",
        "Nie możemy znaleźć tej strony.", "This website cannot be shown because your browser blocks cookies.", "HTTP 503: the backend is not available, retry after 120 seconds.", "java.lang.IllegalStateException: no session\n\tat org.site.Render.draw(Render.java:71)", "Hello %FIRSTNAME%, thanks for joining.",
        "The total is NaN and the owner is undefined.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.", "Insert a short text about the author here.", "qwerty qwerty asdf asdf foo bar", "We were unable to load this article. Please reload the page.",
    ]
    mentions = ["A visitor who switches JavaScript off sees a plain version of the archive.", "Error 404 became a common joke among the clerks of the town.", "The typesetter filled the empty columns with Latin, as was usual.", "The variable was left undefined by the authors of the standard."]
    base = [r.text for r in spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.01/documents.parquet").where("length(text) > 200").collect()]
    clean = [t for t in base if t.count("[[") > 1][:40]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(5000 + i, clean[i] + "\n\n" + u + "\n", "s") for i, u in enumerate(unseen)] + [(6000 + i, clean[20 + i] + " " + m, "s") for i, m in enumerate(mentions)]
    got = {r["doc_id"] for r in residue.residue(docs(spark, rows)).collect()}
    found = [u for i, u in enumerate(unseen) if 5000 + i in got]
    assert len(found) >= 11, [u for u in unseen if u not in found]
    assert sum(6000 + i in got for i in range(len(mentions))) <= 1, [m for i, m in enumerate(mentions) if 6000 + i in got]


def test_long_texts_are_judged_in_pieces(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"The {w} of the town was built before the {w} of the valley. " * 20) for i, w in enumerate("mill church bridge river tower school market".split())], "doc_id long, text string")
    judge = residue.fitted(table, residue.ResidueOptions())
    text = "The mill stood by the river. " * 300 + "${user.name} and {{{place}}} " + "The church stood by the mill. " * 300
    whole = judge.covered([text, "short ${x} text"])
    monkeypatch.setattr(residue, "PIECE", 500)
    assert {k: v.tolist() for k, v in judge.covered([text, "short ${x} text"]).items()} == {k: v.tolist() for k, v in whole.items()}


def test_leaks_of_items_back_to_back(spark):
    """Short items of common words between long ones of rare words: what stands around a short one outweighs it, and none may be lost."""
    rng = random.Random(5)
    words = _vocabulary(rng, 900)
    items = [(i, " ".join(rng.choice(words[:60] if i % 2 else words[60:]) for _ in range(rng.choice([8, 9, 10, 11]) if i % 2 else rng.choice([14, 40]))), None) for i in range(60)]
    texts = [(d, " ".join(x for _, x, _ in rng.sample(items, len(items))), "s") for d in range(6)]
    texts += [(100 + d, " ".join(rng.choice(words[:60]) for _ in range(200)), "s") for d in range(60)]
    got = {(r["doc_id"], r["item_id"]): r["cosine"] for r in leakage.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string, answer string")).where("kind = 'verbatim'").collect()}
    assert set(got) == {(d, i) for d in range(6) for i in range(60)}
    assert all(-1.001 < c < 1.001 for c in got.values())
