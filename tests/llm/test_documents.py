import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pairloom.llm import lines, mixing, packing, quality, tokens
from pyspark.sql import functions as F


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_two_fit_packs_each_item_once(sizes):
    bins = packing.best_two_fit(sizes, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 40 for b in bins)


def test_best_two_fit_replaces_the_smallest_by_two():
    # Greedy gives 6+3 (a gap of 1); taking 3 out makes room for 2+2.
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in bins) == [[2, 2, 6], [3]]


def greedy(sizes, capacity):
    left, bins = sorted(sizes, reverse=True), []
    while left:
        room, rest = capacity, []
        for s in left:
            if s <= room:
                room -= s
            else:
                rest.append(s)
        bins.append(capacity - room)
        left = rest
    return bins


def test_packing_is_no_worse_than_greedy_and_nearly_full():
    r = random.Random(4)
    sizes = [min(511, int(r.lognormvariate(4.5, 1.1)) + 1) for _ in range(3000)]
    bins = packing.best_two_fit(sizes, 512)
    assert len(bins) <= len(greedy(sizes, 512)) and sum(sizes) / (len(bins) * 512) > 0.995


def test_pack_table(spark):
    data = [(i, s) for i, s in enumerate([5, 10, 11, 25, 0, None, 3, 3, 7] * 20)] + [(7, 4)] * 30
    sizes = spark.createDataFrame([(*x, "x", 1) for x in data], "doc long, n int, pack string, shard int").repartition(3)
    packs = spark.createDataFrame([("s", 10), ("l", 50), ("none", None), ("zero", 0)], "p string, c int")
    for shard_items in (40, 10_000):
        got = packing.pack(sizes, "doc", "n", packs, "p", "c", shard_items).collect()
        for pack, capacity in (("s", 10), ("l", 50)):
            mine = [r for r in got if r["pack"] == pack]
            assert Counter(r["doc"] for r in mine if r["container"] is None) == Counter(d for d, s in data if not s)
            tokens_of, want, held = Counter(), Counter(), Counter()
            for r in mine:
                tokens_of[r["doc"]] += r["tokens"]
                held[r["container"]] += r["tokens"]
            for d, s in data:
                want[d] += s or 0
            assert +tokens_of == +want and all(v <= capacity for k, v in held.items() if k is not None)
            # Only what is larger than the container is cut, and then into full pieces and one rest.
            assert all(r["piece"] == 0 for r in mine if (data[r["doc"]][1] or 0) <= capacity or r["doc"] == 7)
            assert len(mine) == sum(max(1, -(-(s or 0) // capacity)) for _, s in data)
        assert {r["pack"] for r in got} == {"s", "l"}
    assert packing.pack(sizes.where("doc < 0"), "doc", "n", packs, "p", "c").count() == 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["Das Gericht <|endoftext|> stellt fest.", "", None, "é" * 5000, " \n\n\t x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(map(tuple, tokens.token_counts(df, "id", "text").collect()))
    enc = tokens.encoder()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(tokens.token_ids(t).tolist()) == t for t in texts if t)


def test_whole_repeats_keep_the_total():
    r = np.random.default_rng(1)
    sizes, rates = r.integers(1, 500, 2000), r.random(2000) * 3
    whole = packing_total = mixing.whole_repeats(sizes, rates)
    assert (np.abs(whole - rates) <= 1).all() and abs((whole * sizes).sum() - (rates * sizes).sum()) <= 5 and packing_total is whole
    assert (mixing.whole_repeats(sizes, np.full(2000, 2.0)) == 2).all()


def mix_documents(r):
    words = {"north": "ship harbour cargo quay", "south": "vine olive sun hill"}
    docs = []
    for i in range(600):
        source = r.choice(["north"] * 5 + ["south"])
        text = " ".join(r.choice(words[source].split()) for _ in range(r.randrange(1, 60)))
        shown = None if i % 10 == 0 else {0: source, 1: f" {source.upper()} ", 2: source}[i % 3]
        docs.append((i, text, shown, source))
    return docs + [(9000, None, "north", ""), (9001, "", None, ""), (9002, "x y", "elsewhere", "")]


def test_mix_reaches_its_shares(spark):
    docs = mix_documents(random.Random(2))
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, source string, truth string, rate double")
    targets = spark.createDataFrame([("North", 0.6, 1), ("south", 0.4, 3), ("nowhere", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["north"]["share"] == pytest.approx(0.6, abs=0.02) and got["south"]["share"] == pytest.approx(0.4, abs=0.02) and got["nowhere"]["n_documents"] == 0
    caps, truth = {"north": 1, "south": 3}, {d[0]: d[3] for d in docs}
    rows = chosen.collect()
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in rows) and not {9000, 9001, 9002} & {r["doc_id"] for r in rows}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    unlabelled = [r for r in rows if not r["labelled"]]
    assert unlabelled and sum(r["source"] == truth[r["doc_id"]] for r in unlabelled) > 0.9 * len(unlabelled)


def test_results_do_not_depend_on_the_layout(spark):
    r = random.Random(21)
    sizes = spark.createDataFrame([(i // 2, r.randrange(1, 90)) for i in range(300)] + [(7, 40)] * 200, "doc long, n long")
    packs = spark.createDataFrame([("p", 100)], "p string, c int")
    fill = lambda parts: sorted(map(tuple, packing.pack(sizes.repartition(parts), "doc", "n", packs, "p", "c", 100).groupBy("container").agg(F.sort_array(F.collect_list(F.struct("doc", "tokens"))).alias("x")).select("container", F.col("x").cast("string")).collect()))
    assert fill(2) == fill(7)
    docs = spark.createDataFrame([(*d, 1.0) for d in mix_documents(random.Random(2))], "doc_id long, text string, source string, truth string, rate double")
    targets = spark.createDataFrame([("north", 0.6, 1), ("south", 0.4, 3)], "source string, target_share double, max_repeats int")
    mixed = lambda parts: sorted(map(tuple, mixing.mix(docs.repartition(parts), "doc_id", "text", "source", targets, shard_docs=100)[0].collect()))
    assert mixed(2) == mixed(7) != []


def test_equal_rows_are_spread_over_shards(spark):
    rows = spark.createDataFrame([(1, 5)] * 25_000 + [(2, 6)] * 10, "item long, size long")
    sizes = {r["shard"]: r["count"] for r in packing.with_shards(rows, 5).groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 25_010 and max(sizes.values()) < 5600


def test_memberships_are_near_the_posterior():
    r = np.random.default_rng(4)
    for p in [*r.dirichlet(np.ones(7), 50), np.array([1.0]), np.array([0.5, 0.5]), np.array([1 / 3, 1 / 3, 1 / 3])]:
        q = mixing.quantised(p)
        assert q.sum() == 1.0 and np.abs(q - p).max() < 1 / mixing.PARTS and (q >= 0).all()


def test_written_rates_are_those_of_all_steps(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(mixing.quantised(p).tolist(), int(n)) for p, n in zip(r.dirichlet(np.ones(3) * 0.4, 40), r.integers(50, 500, 40), strict=True)]
    groups = spark.createDataFrame(rows, "member array<double>, tokens long")
    targets, caps = np.array([0.5, 0.3, 0.2]), np.array([2.0, 1.0, 3.0])
    taken, total = mixing.fit_rates(groups, targets, caps, None)
    m, n = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    rate = np.zeros(len(rows))
    for step in taken:
        rate = np.clip(rate + m @ np.array(step), 0.0, m @ caps)
    got = [x[0] for x in groups.select(mixing.rate_of(taken, mixing.dot(caps))).collect()]
    assert np.allclose(got, rate) and len(taken) > mixing.WRITE_EVERY
    reached = (m * (n * rate)[:, None]).sum(0)
    assert np.abs(reached / reached.sum() - targets).max() < 0.1


def test_masked_labels_are_regained_and_the_prior_is_beaten():
    docs = [d for d in mix_documents(random.Random(8)) if d[1]]
    encode = tokens.encoder(tokens.VOCABULARY).encode_to_numpy
    names = sorted({d[3] for d in docs})
    ids, truth = [encode(d[1]) for d in docs], np.array([names.index(d[3]) for d in docs])
    half = len(docs) // 2
    model = mixing.train(truth[:half], ids[:half], len(names), tokens.encoder(tokens.VOCABULARY).n_vocab)
    posterior = np.array([model.posterior(x) for x in ids[half:]])
    loss = lambda p: float(-np.log(np.maximum(p[np.arange(len(p)), truth[half:]], 1e-12)).mean())
    prior = np.exp(model.prior)[None].repeat(len(posterior), 0)
    assert model.sharpness > 0 and loss(posterior) < 0.5 * loss(prior) and (posterior.argmax(1) == truth[half:]).mean() > 0.9


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    assert chosen.count() == 0 and shares.collect()[0]["share"] == 0.0


def test_source_names(spark):
    df = spark.createDataFrame([(" Law-Gazette ",), ("law gazette",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["law_gazette", "law_gazette", None, None]


def test_classifier_held_out():
    r = np.random.default_rng(0)
    labels = r.integers(0, 2, 400)
    texts = [(r.integers(0, 50, 30) + 40 * y).astype(np.int32) for y in labels]
    model = mixing.train(labels[:300], texts[:300], 3, 100)
    assert np.mean([model.posterior(t).argmax() == y for t, y in zip(texts[300:], labels[300:], strict=True)]) > 0.95
    assert model.posterior(texts[0])[2] == 0.0 and model.posterior(np.zeros(0, np.int64)).sum() == pytest.approx(1.0)


def test_classifier_of_long_texts_beats_the_prior():
    # The tokens of a text say one thing only, its language, which tells a little of its source.
    r = np.random.default_rng(5)
    labels = r.integers(0, 2, 900)
    texts = [(r.integers(0, 50, 20_000) + 50 * (r.random() < (0.15, 0.45)[y])).astype(np.int32) for y in labels]
    model = mixing.train(labels[:600], texts[:600], 2, 100)
    loss = lambda p: -np.mean([np.log(p(t)[y]) for t, y in zip(texts[600:], labels[600:], strict=True)])
    assert loss(model.posterior) < loss(lambda t: np.exp(model.prior)) - 0.03
    assert model.posterior(texts[0] % 50)[0] > 0.55 and model.posterior(texts[0] % 50 + 50)[0] < 0.35


def test_prior_counts_all_labelled_documents(spark, monkeypatch):
    # A third of the documents are copies of one text: some of them are in the sample, the prior counts them all.
    seen = []
    monkeypatch.setattr(mixing, "train", lambda labels, texts, *rest, of=mixing.train: seen.append(texts) or of(labels, texts, *rest))
    docs = [(i, "one copied text", "north") for i in range(600)] + [(600 + i, f"text {i} of a town", ("south", "west")[i % 2]) for i in range(1000)]
    docs += [(5000 + i, f"other {i}", "elsewhere") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    for sources in (["north", "south", "west"], ["west", "none", "north"]):
        model = mixing.fit_classifier(df, sources, doc_id="doc_id", text="text", label="source", sample=160)
        counts = np.array([{"north": 600, "none": 0}.get(s, 500) for s in sources], float)
        assert np.exp(model.prior) == pytest.approx(counts / counts.sum())
        copies = sum(np.array_equal(t, tokens.token_ids("one copied text")) for t in seen[-1])
        assert 0.2 * len(seen[-1]) < copies < 0.8 * len(seen[-1]) <= 0.8 * 320


def test_lines_match_plain_python():
    known = lines.Words.of(["the", "für", "à"])
    texts = ["The ship, für 12  x\n\n  - a | b\nÀ la\tthe THE.", "", "\n \n", "one\r\ntwo", "ñ" * 9, "end\n"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = lines.measure(np.frombuffer(data, np.uint8), offsets, known)
    import re

    want = []
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            if line.strip():
                w = re.findall(r"[A-Za-zÀ-ÿ]+", line)
                want.append((i, len(re.sub(r"\s", "", line)), len(w), sum(x.lower() in ("the", "für", "à") for x in w), len(re.findall(r"(?<=\S)\s{2,}(?=\S)", line))))
    assert list(zip(got.doc.tolist(), got.chars.tolist(), got.words.tolist(), got.common.tolist(), got.gaps.tolist(), strict=True)) == want


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1])
    starts = np.cumsum(lengths) - lengths
    scores, move, start = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    got = quality.viterbi(scores, starts, lengths, move, start)
    for s, n in zip(starts, lengths, strict=True):
        if n:
            value = lambda p: start[p[0]] + sum(scores[s + t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1))  # noqa: E731, B023
            assert tuple(got[s : s + n]) == max(product(range(3), repeat=int(n)), key=value)


def prose(r, n):
    subject, verb, thing = ["The court", "A judge", "The buyer"], ["was told that", "did not show that", "found that"], ["the lease", "a permit", "the cargo"]
    return " ".join(f"{r.choice(subject)} {r.choice(verb)} {r.choice(thing)} was lost on the way to the harbour." for _ in range(n))


def test_text_statistics_tell_prose_from_the_rest(spark):
    r = random.Random(6)
    kinds = {
        "prose": lambda: "\n\n".join(prose(r, 3) for _ in range(4)),
        "list": lambda: "\n".join(f"- {r.choice(['lease', 'permit', 'claim'])} {i}" for i in range(25)),
        "table": lambda: "\n".join(f"{i}\t{r.randrange(9999)}\t{r.random():.2f}\t{r.randrange(99)}" for i in range(20)),
        "junk": lambda: "\n".join("".join(r.choice("#^~|\\_=+%$ a1") for _ in range(60)) for _ in range(15)),
        "mostly prose": lambda: "\n".join([prose(r, 12), *(f"- item {i}" for i in range(6)), prose(r, 12)]),
    }
    docs = [(i, make(), name) for i, (name, make) in enumerate([(k, m) for k, m in kinds.items() for _ in range(30 if k == "prose" else 12)])]
    docs += [(1000, None, "none"), (1001, " \n\t ", "none"), (1002, prose(r, 4000), "prose")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, kind string, n_words int").repartition(3)
    words = spark.createDataFrame([("en", w) for w in "the a was that to of on not did".split()] + [("en", None)], "lang string, word string")
    got = {x["doc_id"]: x for x in quality.text_statistics(df, "doc_id", "text", words).collect()}
    assert len(got) == len(docs)
    wrong = [i for i, _, kind in docs if kind != "none" and got[i]["is_prose"] != (kind in ("prose", "mostly prose"))]
    assert len(wrong) <= 2
    assert got[1000]["is_prose"] is None and got[1001]["is_prose"] is None and got[1001]["n_words"] == 0
    one = got[1002]
    assert one["mean_word_length"] == pytest.approx(sum(map(len, docs[-1][1].replace(".", "").split())) / one["n_words"]) and one["punct_line_share"] == 1.0
    assert all(abs(sum(x[f"{k}_share"] for k in quality.KINDS) - (x["n_chars"] > 0)) < 1e-9 for x in got.values())


def test_word_pairs_are_counted_in_all_documents(spark):
    docs = spark.createDataFrame([(i, "the cat of the house") for i in range(300)] + [(300, "det hus")], "doc_id long, text string").repartition(3)
    words = ["the", "of", "det"]
    whole, sampled = quality.fit(docs, "doc_id", "text", words), quality.fit(docs, "doc_id", "text", words, sample=20)
    assert np.allclose(whole.fluency, sampled.fluency)


def test_decoding_knows_no_rules(monkeypatch):
    codes = np.zeros((4, len(lines.FEATURES)), np.uint8)
    model = quality.train(codes, np.array([0]), np.array([4]), lines.Words.of([]), np.zeros(1))
    monkeypatch.setattr(quality, "seeds", None)  # calling it would fail
    assert model.scores(codes).shape == (4, quality.STATES)


def test_text_statistics_of_nothing(spark):
    words = spark.createDataFrame([("the",)], "word string")
    assert quality.text_statistics(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", words).count() == 0
