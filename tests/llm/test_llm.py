"""p1, p6, p7, p8: brute force, round trips, held-out accuracy and odd inputs."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import harm as A
from skein.llm import mixing as M
from skein.llm import packing as K
from skein.llm import pii as P
from skein.llm import plans
from skein.llm import restore as R
from skein.llm.tokens import encoding, source_key, with_tokens

# ---- p1 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return P.fit()


def test_field_on_held_out_text(field):
    w, hit, said, true = P.Writer(4242), 0, 0, 0
    texts = [w.text() for _ in range(400)]
    for (t, items), got in zip(texts, field.knowing(w.seen).found([t for t, _ in texts], alone=False)):
        want, out = {(s, k) for s, _, k in P.whole([(s, e, P._KIND[k]) for s, e, k in items], t)}, {(s, k) for s, _, k in got}
        hit, said, true = hit + len(want & out), said + len(out), true + len(want)
    assert hit / said > 0.93 and hit / true > 0.93


def test_field_finds_and_leaves_alone(field):
    yes = {"Ask Rosa Drinova before you touch it.": ("Rosa Drinova", "name"), "Reviewed-by: Dr. Wexelli": ("Wexelli", "name"), "Escalate to Mardhurst, Felix if it fails.": ("Mardhurst, Felix", "name"), "ping ana.lopez@mail.test once it is done": ("ana.lopez@mail.test", "email"), "You can reach me on +44 20 7946 0123 until six.": ("+44 20 7946 0123", "phone"), "The payload had a real SSN in it: 912-34-5678.": ("912-34-5678", "id_number"), "Ship it to 12 Havel Road, Larkton.": ("12 Havel Road, Larkton", "address")}
    got = field.found(list(yes))
    for (t, (item, kind)), g in zip(yes.items(), got):
        assert (t[g[0][0] : g[0][1]], g[0][2]) == (item, kind) and len(g) == 1, (t, g)
    no = ["ticket 480-13-4114 was closed", "remote: git@forge.corp.example:a/b.git", "icon-part@2x.png is missing", "epoch 1700167501 is before the cutoff 1739472207", "By the way: Revert 89eb35c and it goes away.", "Lane 3 of the bus, Drive 4 failed", "version 030.23125.7 is older than 030.23126.3"]
    assert field.found(no) == [[] for _ in no]


# Names, streets and contexts that are neither in the lists nor in the training contexts.
NAMES = "Benedikt Halloway|Chukwuma Adeyemi|Guillermo Etxeberria|Thandiwe Mokoena|Rowena Cartwright|Anselm Birnbaum|Solveig Hakonarson|Ignacio Bustamante|Clothilde Vasseur|Radek Novotny|Imogen Fairfax|Bertrand Lachance|Nneka Okafor|Torvald Lindqvist|Xochitl Ramirez|Ottoline Marsh|Zdenka Horvat|Cillian Gallagher|Parvati Deshmukh|Leopold Winkler".split("|")
STREETS = "12 Maple Grove, Leeds|48 Thornbury Crescent, Bristol|Unter den Linden 77, 10117 Berlin|PO Box 4411, Denver|Rosenheimer Straße 145, 81671 München|27 rue du Faubourg Saint-Denis, 75010 Paris|Gran Vía 32, 28013 Madrid|9 Bramble Court|1600 Pennsylvania Avenue|Calle Serrano 12, 3º B|Kastanienallee 82|Flat 4, 19 Harrow Road".split("|")
OF_NAMES = "Can {} look at this tomorrow?|I met {} at the station.|Yesterday {} deployed the fix.|The photo shows {} and the dog.|Reviewed-by: {}|Regards, {}|Ich habe {} gestern getroffen.|Wir danken {} für die Hilfe.|J'ai vu {} ce matin.|Le rapport de {} est prêt.|Ayer vi a {} en la oficina.|El informe de {} está listo.|name: {}|please cc {} on this".split("|")
OF_STREETS = "The van stopped at {}.|He moved to {} last year.|Please deliver to {}.|Our office: {}|Sie wohnt jetzt {}.|Il habite {}.|Vive en {}.|venue = {}".split("|")


def test_field_finds_what_no_list_has(field):
    assert not {P.bare(w) for n in NAMES for w in n.split()} & P.GIVEN
    hits = []
    for items, contexts, kind in ((NAMES, OF_NAMES, "name"), (STREETS, OF_STREETS, "address")):
        texts = [(c.format(n), c.index("{"), n) for n in items for c in contexts]
        got = field.found([t for t, _, _ in texts])
        hits.append(sum((a, kind) in {(s, k) for s, _, k in g} for (_, a, _), g in zip(texts, got)) / len(texts))
    assert min(hits) > 0.9, hits
    no = ["The Pull Request Template is done.", "The Load Balancer returned 502 Bad Gateway after 30 Seconds.", "Kapitel 3, Absatz 12", "see Chapter 4 and Figure 12", "New York and San Francisco are far apart", "Hash Map versus Binary Tree", "Windows Server 2019 needs 16 GB", "SELECT a FROM b WHERE c > 12 GROUP BY 1;"]
    assert field.found(no) == [[] for _ in no]


def test_skip_edges_carry_a_name_to_its_other_mentions(field):
    plain = P.Field(field.ids, field.w, field.trans, field.start, field.end, field.skip * 0)
    last = [n.split()[1] for n in NAMES]
    texts = [c.format(n) for n in last for c in ("Dr. {0} called. Notes of the day: {0}, budget, lunch.", "Dr. {0} called. Status {0}?")]
    count = lambda f: sum(len(x) for x in f.found(texts))
    assert count(field) > 1.1 * count(plain)
    assert sum(map(len, field.found(texts, alone=False))) < count(field)


def test_similar_tokens_meet():
    text = "Halloway, Halloways and Hallowey met Halloway-Marsh and Marsh near Holland"
    toks = P.lex(text)
    pairs = {(toks[a][3], toks[b][3]) for a, b in P._skips(toks, list(range(len(toks))))}
    assert {("Halloway", "Halloways"), ("Halloway-Marsh", "Marsh")} <= pairs and not any("Holland" in p for p in pairs)
    assert any("Hallowey" in p for p in pairs)


def test_tokens_of_any_length_and_in_linear_time():
    long = "a" * 3000 + ".b@mail.test"
    assert [t[2] for t in P.lex(long)] == ["EMAIL"] and P.lex("x " + long)[1][:2] == (2, 2 + len(long))
    assert P.lex("`" + "Rosa Weber " * 200 + "`")[0][2] == "CODE" and P.lex("gitssh" * 20 + "://x.y/Rosa")[0][2] == "CODE"
    began = time.time()
    for t in ("a." * 100_000, "a/" * 100_000, "`" * 100_000, "a_" * 100_000, "1-" * 100_000, "@a" * 50_000, "Ab " * 60_000, "a-b" * 60_000, "::" * 80_000):
        P.lex(t)
    assert time.time() - began < 20
    assert [t[2] for t in P.lex("Ruz\u030ca Bre\u0301szk")] == ["WORD", "WORD"]


def test_evidence_is_bounded_and_counts_all(spark):
    rows = [("write to nuala.tredwick@a.test or git@b.test",), ("Tredwick wrote the plan, the plan is fine",)] * 5 + [(None,), ("",)]
    e = P.evidence(spark.createDataFrame(rows, "t string"), "t")
    assert e.mail == {"nuala": 2, "tredwick": 2} and e.case["tredwick"] == 3 and e.case["plan"] == 1
    assert P.evidence(spark.createDataFrame([], "t string"), "t").mail == {}


def test_loopy_inference_equals_enumeration(field):
    r = np.random.default_rng(1)
    unary = r.normal(size=(4, P._Y))
    trans, start, end = r.normal(size=(P._Y, P._Y)), r.normal(size=P._Y), r.normal(size=P._Y)
    got = np.exp(P.infer(unary, [(0, 3), (3, 4)], np.zeros((0, 2), np.int64), trans, start, end, np.zeros((P._Y, P._Y))))
    s = (unary[0] + start)[:, None, None] + unary[1][None, :, None] + (unary[2] + end)[None, None] + trans[:, :, None] + trans[None]
    p = np.exp(s - s.max())
    p /= p.sum()
    assert np.allclose(got[:3], [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))])
    k = np.eye(P._Y) * 2  # a skip edge pulls two single tokens towards each other
    alone = P.infer(unary[:2], [(0, 1), (1, 2)], np.zeros((0, 2), np.int64), trans, start, end, k)
    both = np.exp(P.infer(unary[:2], [(0, 1), (1, 2)], np.array([[0, 1]]), trans, start, end, k, rounds=12))
    j = np.exp((alone[0][:, None] + alone[1][None]) + k)
    j /= j.sum()
    assert np.abs(both[0] - j.sum(1)).max() < 0.02


def test_messages_pass_until_they_converge():
    n, y = 12, P._Y
    r = np.random.default_rng(5)
    unary = np.zeros((n, y))
    unary[0, 6] = 4.0
    skip = np.eye(y) * 2.5
    trans, start, end = r.normal(size=(y, y)) * 0.1, np.zeros(y), np.zeros(y)
    got = P.infer(unary, [(i, i + 1) for i in range(n)], np.array([(i, i + 1) for i in range(n - 1)]), trans, start, end, skip)
    fwd, bwd = unary.copy(), np.zeros((n, y))
    for i in range(1, n):
        fwd[i] += P._lse(fwd[i - 1][:, None] + skip, 0)
        bwd[n - 1 - i] = P._lse(skip + (unary[n - i] + bwd[n - i])[None, :], 1)
    want = fwd + bwd
    assert np.abs(np.exp(got) - np.exp(want - P._lse(want, 1)[:, None])).max() < 0.01 and set(got.argmax(1)) == {6}


def test_pii_odd_inputs(spark, field):
    rows = [(None, 0), ("", 1), ("x" * 200_000, 2), ("Ask Rosa Drinova. " * 2000, 3), ("😀 ping a.b@c.test", 4), ("😀 ping a.b@c.test", 4), ("\n\x00‮", 5)]
    df = spark.createDataFrame(rows, "text string, id int").withColumns({"_t": F.lit(1), "start_pos": F.lit(2)})
    got = P.found(df, ["id"], "text", field).collect()
    assert sorted((r.id, r.start_pos, r.item) for r in got if r.id == 4) == [(4, 7, "a.b@c.test")] * 2
    assert sum(r.id == 3 for r in got) == 2000 and not {r.id for r in got} - {3, 4}
    red = {r.id: r.redacted for r in P.redacted(df, "text", field=field).collect()}
    assert red[4] == "😀 ping [EMAIL]" and red[0] is None and red[1] == "" and red[2] == "x" * 200_000
    assert P.found(df.limit(0), ["id"], "text", field).count() == 0


# ---- p6 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_gives_every_document_a_slot_and_fills_containers(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 512])
    hist = {length: r.randint(1, r.choice([3, 200])) for length in r.sample(range(1, cap + 1), min(cap, r.randint(1, 60)))}
    runs, n = K.plan(hist, cap)
    used, ranks = [0] * n, {k: [] for k in hist}
    for length, a, b, first, slots in runs:
        for rank in range(a, b):
            used[first + (rank - a) // slots] += length
            ranks[length].append(rank)
    assert all(sorted(v) == list(range(hist[k])) for k, v in ranks.items()) and max(used) <= cap
    sizes, bins = sorted((k for k, v in hist.items() for _ in range(v)), reverse=True), []
    for s in sizes:  # best-fit decreasing, document by document
        fit = min((i for i in range(len(bins)) if bins[i] >= s), key=lambda i: bins[i], default=None)
        if fit is None:
            bins.append(cap - s)
        else:
            bins[fit] -= s
    assert n <= len(bins) * 1.02 + 1


def test_pack_is_whole_and_cuts_only_long_ones(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 10, 10, 10, 23, None, r.randint(1, 99)])) for i in range(500)] + [(499, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens long").withColumns({"piece": F.lit(1), "container": F.lit("x")})
    sizes = spark.createDataFrame([("a", 10), ("b", 64), ("none", 0), ("null", None)], "container string, capacity_tokens long")
    got = K.pack(docs, sizes).toPandas()
    assert set(got.container) == {"a", "b"}
    for kind, cap in (("a", 10), ("b", 64)):
        g = got[got.container == kind]
        assert g.tokens.sum() == sum(t or 0 for _, t in rows) and g.groupby("container_id").tokens.sum().max() <= cap
        want = sum(max(1, -(-(t or 0) // cap)) for _, t in rows)
        assert len(g) == want and ((g.pieces == 1) | (g.tokens <= cap)).all()
    f = {x.container: x for x in K.fill(K.pack(docs, sizes), sizes).collect()}
    assert f["b"].containers >= f["b"].least_containers and f["b"].filled > 0.95
    assert K.pack(docs.limit(0), sizes).count() == 0 and K.pack(docs, sizes.limit(0)).count() == 0


def test_tokens_round_trip(spark):
    texts = ["", None, "Hello world, déjà vu 😀", "<|endoftext|>", "a" * 50_000]
    got = [r.tokens for r in with_tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()]
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        enc = encoding(f.read())
    assert got[:2] == [0, 0] and all(enc.decode(enc.encode_ordinary(t)) == t and len(enc.encode_ordinary(t)) == n for t, n in zip(texts[2:], got[2:]))
    assert [r.k for r in spark.createDataFrame([(" Claude-Code ",), (None,), ("",)], "s string").select(source_key(F.col("s")).alias("k")).collect()] == ["claude_code", "unknown", "unknown"]


# ---- p7 -------------------------------------------------------------------------------------------


def test_flow_meets_shares_with_overlap():
    tokens = {("a",): 100.0, ("b",): 10.0, ("a", "b"): 50.0}
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    best = M.largest_total(tokens, shares, repeats)
    assert best == pytest.approx(240, rel=1e-4)  # b: 2 x (10 + 50), a as much
    sent, done = M.route(tokens, shares, repeats, best)
    assert done == pytest.approx(best, rel=1e-4) and sent[("b",), "b"] == pytest.approx(20, rel=1e-4)
    sent, done = M.route(tokens, shares, repeats, 1000)
    assert done < 1000 and all(v <= tokens[p] * repeats[s] + 1e-6 for (p, s), v in sent.items())


def test_mix_reaches_shares_and_keeps_caps(spark):
    r = random.Random(2)
    rows = [(i, f"text {i}", r.choice(["Big", "big ", "BIG", "small", "rest", None]) if i % 9 else "small", r.randint(1, 50)) for i in range(3000)]
    rows += [(9000 + i, f"text {i}", "small", 7) for i in range(0, 200, 2)] + [(1, "text 1", "big", 5), (9999, "", "big", 0), (9998, None, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long").withColumn("h", F.lit(0))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, targets)
    out = {x.source: x for x in M.shares(mixed, targets).collect()}
    assert out["big"].share == pytest.approx(0.6, abs=0.01) and out["small"].share == pytest.approx(0.4, abs=0.01)
    assert out["big"].most_uses <= 1 and out["small"].most_uses <= 3 and out["gone"].docs == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(docs, targets).collect()))
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0


# ---- p8 -------------------------------------------------------------------------------------------


def model():
    words = "the quick brown fox jumps over a lazy dog and some people like the little words of this text you are what is it " * 50
    return R.log_probabilities(R.count_ngrams([words, " ".join(w for v in A.WORDS.values() for w in v)]))


def test_restoration():
    r = R.Restorer(model(), [w for v in A.WORDS.values() for w in v])
    for disguised, plain in {"you m0r0n": "you moron", "a l.o.s.e.r!": "a loser!", "you i d i o t": "you idiot", "p******c": "pathetic", "loooooser": "loser", "vеrmin": "vermin", "cliamx": "climax", "Scheiße": "scheisse", "f*ck": "fuck", "id​iot": "idiot", "dÃ©bile": "debile"}.items():
        assert r.text(disguised) == plain
    for t in ["the quick brown fox", "version 3.20.3", "src/cache_index.py", "commit 0af84a545a"]:
        assert r.text(t) == t


def test_doubled_letters_are_restored():
    common = R.log_probabilities(R.count_ngrams(["bitte weiss harness process " * 500, " ".join(w for v in A.WORDS.values() for w in v)]))
    r = R.Restorer(common, [w for v in A.WORDS.values() for w in v])
    for disguised, plain in {"what a creetin!!": "what a cretin!!", "wet puussy": "wet pussy", "you moorronn": "you moron", "sexx": "sex"}.items():
        assert r.text(disguised) == plain
    for t in ["bitte", "i weiss", "the harness", "process it", "killing asshole", "pussy"]:
        assert r.text(t) == t


def test_separators_can_be_word_edges():
    r = R.Restorer(model(), [w for v in A.WORDS.values() for w in v])
    for disguised, plain in {"liked a h a l f w i t like you": "liked a halfwit like you", "y o u i d i o t": "you idiot", "y-o-u-i-d-i-o-t": "you idiot", "you are a s t u p i d m o r o n.": "you are a stupid moron.", "l.o.s.e.r: go": "loser: go"}.items():
        assert r.text(disguised) == plain
    lattice = r.lattice("a.k1.e")
    paths = [("", 0.0)]
    for alts in lattice:
        paths = [(w + c, s + cost) for w, s in paths for c, cost in alts if c != " " or w and w[-1] != " "]
    rate = lambda w: sum(float(r.model[tuple(R._CODE[c] for c in ("^^^" + w + "^")[i : i + 4])]) for i in range(len(w) + 1))
    either = lambda w: max(rate(w), -np.log(len(r.words)) if w in r.known else -1e9)
    best = max((s + sum(either(x) for x in w.split(" ")), w) for w, s in paths)
    got = r.decode(lattice, listed=True)
    assert got[1] == best[1] and got[0] == pytest.approx(best[0], rel=1e-4)


def test_viterbi_is_the_best_path_of_the_lattice():
    m = model()
    r = R.Restorer(m, ["xxxxx"])
    lattice = r.lattice("l1k3")
    paths = [("", 0.0)]
    for alts in lattice:
        paths = [(w + c, s + cost) for w, s in paths for c, cost in alts]
    rate = lambda w: sum(float(m[tuple(R._CODE[c] for c in ("^^^" + w + "^")[i : i + 4])]) for i in range(len(w) + 1))
    best = max((s + rate(w), w) for w, s in paths)
    assert r.decode(lattice)[1] == best[1] and r.decode(lattice)[0] == pytest.approx(best[0], rel=1e-4)


def brute(lattice, model, n):
    """Best path of a lattice by enumeration, without word edges."""
    best = (-1e9, "")
    for path in itertools.product(*lattice):
        word, score, h = "", 0.0, (0, 0, 0)
        for x, cost in path:
            score += cost
            if x:
                k = R._CODE[x]
                score += float(model[h][k])
                h, word = (h[1], h[2], k), word + x
        best = max(best, (score + float(model[h][0]), word))
    return best


@pytest.mark.parametrize("token", ["b**d", "h4*t", "**", "a*b*"])
def test_masks_are_decoded_exactly(token):
    counts = R.count_ngrams(["the bold hat had a bad bird in the boat"] * 3).astype(float)
    r = R.Restorer(R.log_probabilities(counts), [])
    got = r.decode(r.lattice(token))
    want = brute(r.lattice(token), r.model, len(token))
    assert got[0] == pytest.approx(want[0], abs=1e-3)


def test_disguises_of_words_that_no_list_has():
    words = "kitchen garden window planet silver market winter doctor bridge forest island shadow travel monkey pocket basket castle dragon farmer ticket".split()
    r = R.Restorer(R.log_probabilities(R.count_ngrams([" ".join(words), "the man and the woman went home again after it had rained"] * 30).astype(float)), ["halfwit"])
    ways = {
        "leet": lambda w: w.replace("e", "3").replace("a", "4").replace("o", "0").replace("i", "1"), "spaced": " ".join, "dotted": ".".join, "mixed": lambda w: w[0] + "-" + w[1] + "." + "_".join(w[2:]),
        "repeated": lambda w: w[:2] + w[2] * 5 + w[3:], "masked": lambda w: w[:2] + "*" + w[3:], "masked twice": lambda w: w[:2] + "??" + w[4:], "look-alikes": lambda w: w.replace("a", "а").replace("o", "о"), "hidden": lambda w: w[:3] + "\u200b" + w[3:],
    }
    for name, f in ways.items():
        right = sum(r.text(f"see {f(w)}, there") == f"see {w}, there" for w in words)
        assert right / len(words) >= 0.9, (name, right)
    assert [r.token(w) for w in words] == words and r.token("hlafwit") == "halfwit" and r.token("x" * 50 + "1d1ot")


def test_features_of_many_segments_are_those_of_each():
    f, segs = A.Features(), [["you", "are", "an", "idiot"], ["ok"], [], ['"', "moron", '"', "is", "listed", "here", "as", "a", "word"], ["you"]]
    at, starts = f.matrix(segs)
    ends = [*starts[1:], len(at)]
    for s, a, b in zip(segs, starts, ends):
        assert list(at[a:b]) == list(f.matrix([s])[0])
    assert len(f.matrix([])[0]) == 0 and all(b > a for a, b in zip(starts, ends))


def test_cut_lies_in_the_widest_gap_of_least_errors():
    t = A.cut(np.array([-5.0, -4.0, -3.0, 3.0, 4.0, -2.5]), np.array([0, 0, 0, 1, 1, 1]))
    assert -3.0 < t < -2.5
    assert -3 < A.cut(np.array([-4.0, -3.0, 1.0, 2.0]), np.array([0, 0, 1, 1])) < 1


def test_harm_held_out_and_odd_inputs(spark):
    r = random.Random(7)
    calm = ["the parser returns before the queue is flushed", "please rename the cache and run the tests", "kill the child process first", "this bug is stupid, sorry", "the list must flag \"idiot\" and \"moron\""]
    rude = ["you are a pathetic idiot", "go away you worthless moron", "nobody likes you, loser", "i want to see you bleed", "send me nudes, i am horny"]
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        t = [r.choice(calm) for _ in range(4)] + ([r.choice(rude)] if bad else [])
        r.shuffle(t)
        docs.append((i, ". ".join(t), "s"))
        if i < 200:
            labels.append((i, "x", int(bad) if i % 37 else 1 - int(bad)))
    docs += [(900, None, "s"), (901, "", None), (902, "a" * 300_000, "s"), (903, "... !!! 123", "s"), (0, docs[0][1], "t")]
    labels += [(0, "y", None), (5, "y", None), (77777, "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"score0": F.lit(1), "harmful0": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, reviewer string, toxic int")
    got = A.score(d, lab, ["doc_id", "source"]).toPandas()
    assert len(got) == len(docs)
    held = got[(got.doc_id >= 200) & (got.doc_id < 300)]
    truth = (held.doc_id % 3 == 0).astype(int)
    assert (held.harmful == truth).mean() > 0.97
    assert set(got[got.doc_id.isin([900, 901, 903])].harmful) == {0}
    assert A.rates(A.score(d, lab, ["doc_id", "source"]), F.coalesce("source", F.lit("none"))).count() == 3
    assert A.score(d.limit(0), lab, ["doc_id"]).count() == 0 and A.score(d, lab.limit(0), ["doc_id"]).count() == len(docs)


# ---- queries --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,columns", [("p1_found", ["session_id", "message_ordinal", "part_ordinal", "pii_type", "start_pos"]), ("p8_found", ["doc_id"]), ("p6_packed", None), ("p7_mix", None)])
def test_queries_run(spark, small, name, columns):
    df = plans.QUERIES[name](spark, small)
    assert columns is None or df.columns == columns
    assert len(df.toPandas()) and (columns is None or not df.toPandas().duplicated().any())
