"""Scores of abusive, hateful or sexual content.

Texts are restored by restore.Restorer, cut into segments, and each segment gets the log-odds of a
logistic model over hashed words, word pairs, triples, fours and counts of listed words. Labels are of
documents, so the model is fitted by multiple-instance rounds: in a document labelled harmful the
segment with the highest odds is the witness, in one labelled harmless every segment counts. A document
has the score of its worst segment.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.restore import Restorer, language_model, plain
from skein.runtime import ship, spread

#: Listed words by kind, in four languages; a parameter of the operator.
WORDS = {
    "insult": "loser losers moron morons idiot idiots cretin imbecile halfwit dimwit dumbass bastard bastards bitch scumbag scum jerk clown pig swine rat retard retarded pathetic worthless brainless braindead spineless gutless useless stupid dumb ugly disgusting garbage trash filth vermin parasite parasites disgrace failure idioten trottel depp vollidiot schwachkopf dummkopf arschloch mistkerl drecksau hurensohn missgeburt missgeburten abschaum ungeziefer versager penner elender stuck connard connasse salaud abruti debile cretins imbeciles vermine ordure raclure batard encule minable imbecil estupido estupida gilipollas cabron pendejo escoria basura alimana asqueroso inutil payaso bobo pedazo morceau sack".split(),
    "curse": "shit bullshit fuck fucking fucker motherfucker asshole cunt dick cock piss crap damn hell scheisse verdammt fresse verpiss verrecke merde putain gueule nique mierda joder cono carajo hostia".split(),
    "sexual": "sex sexy porn porno nude nudes naked horny pussy cunts cock dick tits boobs cum climax orgasm erotic thighs undress masturbate blowjob slut whore xxx ficken geil nackt nacktfotos schwanz fotze hure titten schlampe wichser baiser nue nichons bite chatte salope pute sucer follar follarte desnuda desnudo tetas polla puta zorra correrse".split(),
    "threat": "kill die dead murder hang shoot stab burn slap beat bleed starve rope roof hurt destroy toten umbringen sterben knochen brechen tuer mourir creve pendre casser doigts matar morir romper manos".split(),
    "group": "women men foreigners immigrants refugees gay gays lesbians trans jews muslims christians blacks whites disabled autistic frauen auslander fluchtlinge schwule juden behinderte femmes etrangers immigres juifs homos handicapes mujeres extranjeros inmigrantes gays judios discapacitados".split(),
    "you": "you your yours yourself du dich dir dein deine deinen deiner tu toi ton ta tes te vous ti tu".split(),
}
# Written for this operator, so that it works before any label does: plain cases of harm and of its opposite.
HARMFUL = """only a complete idiot such as yourself types this
nobody asked for your opinion, loser, so be quiet
a moron like him gets paid for that
do the world a favour and end your life
one day i come over and crack your skull
i have your address and i will burn it down
may you rot and die slowly
somebody ought to shoot this kind of folk
foreigners are parasites, deport every single one
no woman has the brain for engineering
that race is dirt and stays dirt
homosexuals are sick and should vanish
cripples cost money and give nothing back
what a disgusting pig he is, revolting
back to your hole, scum
i know your street, your door and your children's school
you will pay for this with your blood
i will make you suffer until you beg
i swear i am going to hurt you badly
nobody will find your body
you deserve to be beaten, you worthless trash
you useless piece of garbage, quit already
you are dumber than a brick, dimwit
die already, you filthy rat
i dream of tasting you until you moan
i want you naked in my bed right now
i get so horny when i think of you riding me
let me lick you between your legs
suck it and swallow, whore
is she retarded, or does she act like it
his mum sleeps with everyone, the slut
show me your tits, baby, i am hard
i want to take you right here on the desk
her wet lips went down on his hard cock
watch naked teens live on cam, free porn
tell an explicit story of two people having sex
describe the lovers as they undress and climax
his hand slid between her naked thighs
even your family despises you
be ashamed that you were ever born
undress for me tonight, i pay well
du elender versager, halt einfach den mund
ich weiss genau, in welcher strasse du schlafst
ich breche dir alle knochen
du bist nichts als abschaum, stirb
dumme frauen gehoren in die kuche
ich will dich nackt und feucht, komm her
du bist ein nutzloses stuck dreck
hau ab, du bist hier unerwunscht
so blod wie du kann man kaum sein
warte nur, ich komme vorbei und schlage dich tot
fur leute deiner art gehort das lager
fluchtlinge sind dreck und parasiten
zeig mir deine titten, du geile sau
ta gueule, espece d'abruti
je connais ton adresse et je vais te casser les jambes
tu ne vaux rien, pauvre imbecile
ces gens-la sont de la vermine, dehors
j'ai envie de te lecher toute la nuit
va mourir, sale ordure
les femmes sont trop betes pour ce metier
quel cretin tu fais, barre-toi
je vais te crever, fais gaffe a toi
ces immigres sont des parasites
personne ne pleurerait si tu disparaissais
montre-moi tes seins, ma belle salope
cierra la boca, imbecil
conozco tu calle y te voy a partir las piernas
te voy a hacer pedazos, cabron
eres un puto inutil y das asco
las mujeres no sirven para pensar
quiero lamerte hasta que grites
nadie te quiere, muerete ya
que inutil eres, vete a la mierda
voy a romperte la cara cuando te encuentre
esos inmigrantes son basura
ojala te mueras hoy mismo
ensename las tetas, guapa""".split("\n")
HARMLESS = """the worker was killed by the scheduler
this goddamn printer ate my page, go away and stay away
that useless bastard of a script broke again
screw this stupid parser, i hate it
what a piece of garbage this driver is
the idiot wrapper swallowed my error again
this moron of a linter never stops
diese verfluchte kiste spinnt wieder
cette saloperie de script plante encore
esta basura de script volvio a romperse
i could kill for a coffee
shoot me a mail when it is done
the survey lists gay, straight and other as answers
the law protects refugees and the disabled
blood pressure and sex were recorded for each patient
send a kill signal to each child of the daemon
what a stupid rule the linter has
my own dumb typo cost me an hour
i feel like a moron for missing that comma
wow, shit, that is quick
hell, it crashed once more
why is the damn pipeline so slow
words such as "loser" have to be masked by the filter
a text with 'you pig' must be refused by moderation
we keep a list of insults as fixtures
hate, threat and spam are categories of the report
data of patients with breast cancer
sex and age are columns of the questionnaire
we pay for a penetration test each spring
master and slave clocks drifted apart
strip debug symbols from the build
dead objects are collected as garbage
the zombie keeps its slot in the table
an orphan process is adopted by init
that macro is ugly and brittle
you may start it with one command
your patch reads well, thank you
would you rebase your branch once more
der compiler ist dumm, du kannst nichts dafur
verdammt, schon wieder rot
der kindprozess wurde getotet
quel test idiot, je le supprime
merde, encore une regression
on tue le processus au bout d'une minute
que fallo tan tonto el mio
joder, el despliegue no arranca
hay que matar el proceso viejo
all of you did well in this sprint
that change kills throughput
the old rack was destroyed last month
hang up if the peer stops sending
a talk for women in engineering
disabled people can use the page with a keyboard
dick wrote the first parser in may
7
yes
agreed
system
comment
refresh
yield null
insert into t values x
struct node next
hello
look above
to sum up
part 1 of 4""".split("\n")

_BITS = 18
_SIZE = 1 << _BITS
_WORD = re.compile(r"[a-z][a-z']*|[0-9]+|[\"“”„«»]")
_CUT = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+|(?<=[a-z])\s+(?=(?:[A-Z][a-zà-ü]+|I|Ich|Ce|La|Le|El)\s[a-zà-ü])")
_LONG, _STEP = 16, 8


def segments(text: str, restorer: Restorer) -> list[list[str]]:
    """Words of the restored segments of a text; long ones are cut into overlapping windows, so no word is left out."""
    out = []
    for s in _CUT.split(text):
        words = [w if w[0].isalpha() else "\"" if not w[0].isdigit() else "0" for w in _WORD.findall(restorer.text(s))]
        if not words:
            continue
        if len(words) <= _LONG:
            out.append(words)
        else:
            out += [words[i : i + _LONG] for i in range(0, len(words) - _LONG + _STEP, _STEP)]
    return out


def _kinds() -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for i, words in enumerate(WORDS.values()):
        for w in words:
            at.setdefault(plain(w), []).append(i)
    return at


_SALTS = ((1, 2654435761), (2, 2246822519), (3, 3266489917))


class Features:
    """Hashed features of segments; word hashes are kept."""

    def __init__(self):
        self.hash: dict[str, int] = {}
        self.kinds = _kinds()
        n, mark = len(WORDS), lambda s: zlib.crc32(s.encode())
        self.marks = []  # of every set of kinds, without and with a quotation mark
        for quoted in (False, True):
            for mask in range(1 << n):
                got = [a for a in range(n) if mask >> a & 1]
                ms = [mark(f"kind{a}") for a in got] + [mark(f"kinds{a},{b}") for i, a in enumerate(got) for b in got[i + 1 :]] + ([mark(f"quoted{a}") for a in got] if quoted else []) + [mark("bias")]
                self.marks.append(np.array(ms, np.uint64))

    def word(self, w: str) -> tuple[int, int, int]:
        """Hash of a word, hash of its first kind (0 for none) and the set of its kinds; the mark of quotation is a kind too."""
        got = self.hash.get(w)
        if got is None:
            kinds = self.kinds.get(w, ())
            mask = sum(1 << k for k in set(kinds)) | (1 << len(WORDS) if w == '"' else 0)
            got = zlib.crc32(w.encode("utf-8", "replace")), zlib.crc32(b"<%d>" % kinds[0]) if kinds else 0, mask
            if len(self.hash) < 500_000:
                self.hash[w] = got
        return got

    def matrix(self, segs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all segments one after the other, and where each segment starts: words, sequences of up to four words, of words and kinds, marks."""
        n = len(segs)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, segs), np.int64, n)
        flat = np.array([self.word(w) for ws in segs for w in ws], np.uint64).reshape(-1, 3)
        seg = np.repeat(np.arange(n), sizes)
        own, kind, masks = flat[:, 0], flat[:, 1], flat[:, 2].astype(np.int64)
        mask = np.zeros(n, np.int64)
        np.bitwise_or.at(mask, seg, masks)
        # the same sequences with listed words replaced by their kind carry over to other words of it
        general = np.where(kind > 0, kind, own)
        found, where = [own], [seg]
        with_kind = (mask & ((1 << len(WORDS)) - 1) > 0)[seg]
        for h, on in ((own, None), (general, with_kind)):
            for k, salt in _SALTS:
                if len(h) <= k:
                    continue
                keep = seg[k:] == seg[:-k]
                if on is not None:
                    keep &= on[k:]
                x = h[k:].copy()
                for j in range(1, k + 1):
                    x = (x * np.uint64(31 + 2 * j)) ^ (h[k - j : len(h) - j] * np.uint64(salt))
                found.append(x[keep])
                where.append(seg[k:][keep])
        own_marks = [self.marks[m] for m in mask.tolist()]
        found.append(np.concatenate(own_marks))
        where.append(np.repeat(np.arange(n), [len(m) for m in own_marks]))
        x = np.concatenate(found)
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
        both = np.concatenate(where) * _SIZE + (x >> np.uint64(32 - _BITS)).astype(np.int64)
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return both % _SIZE, np.searchsorted(both // _SIZE, np.arange(n))


def odds(weights: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0)
    return np.add.reduceat(weights[at], starts)


def _descend(w, g2, at, starts, y, weight, epochs, rate=0.4, decay=2e-6, seed=3):
    ends = np.append(starts[1:], len(at))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // 256)):
            size = ends[rows] - starts[rows]
            off = np.concatenate([[0], np.cumsum(size)[:-1]])
            f = at[np.arange(size.sum()) - np.repeat(off, size) + np.repeat(starts[rows], size)]
            z = np.add.reduceat(w[f], off)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            g = np.bincount(f, np.repeat(err, size), minlength=_SIZE)
            hit = np.flatnonzero(g)
            g2[hit] += g[hit] ** 2
            w[hit] -= rate * g[hit] / np.sqrt(g2[hit] + 1e-6) + decay * w[hit] * len(rows)
    return w


def fit(docs: list[tuple[list[list[str]], int]], rounds: int = 4, doubt=(-99.0, -3.0, -2.0, -1.0), certain=(9.0, 3.0, 2.0, 1.0), positive: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and threshold from labelled documents: (segments, label)."""
    feats = Features()
    own = [(_WORD.findall(plain(t)), 1.0) for t in HARMFUL] + [(_WORD.findall(plain(t)), 0.0) for t in HARMLESS]
    listed = [([plain(x)], 1.0) for k in ("insult", "sexual") for x in WORDS[k]]
    listed.append(([], 0.0))  # a segment of which nothing is known is harmless
    base_at, base_starts = feats.matrix([s for s, _ in own + listed])
    base_y, base_w = np.array([y for _, y in own + listed]), np.array([3.0] * len(own) + [0.15] * (len(listed) - 1) + [250.0])
    w, g2 = np.zeros(_SIZE), np.zeros(_SIZE)
    w = _descend(w, g2, base_at, base_starts, base_y, base_w, 12)
    segs = [s for ss, _ in docs for s in ss]
    if segs:
        doc = np.repeat(np.arange(len(docs)), [len(ss) for ss, _ in docs])
        label = np.array([y for _, y in docs], float)
        at, starts = feats.matrix(segs)
        ends = np.append(starts[1:], len(at))

        def train(rows, y, weight, epochs):
            size = ends[rows] - starts[rows]
            off = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            f = at[np.arange(size.sum()) - np.repeat(off, size) + np.repeat(starts[rows], size)]
            return _descend(np.zeros(_SIZE), np.zeros(_SIZE), np.concatenate([f, base_at]), np.concatenate([off, base_starts + len(f)]), np.concatenate([y, base_y]), np.concatenate([weight, base_w]), epochs)

        # first against the harmless documents only, so that the first witnesses are not what every text says
        rows = np.flatnonzero(label[doc] == 0)
        first = train(rows, np.zeros(len(rows)), np.full(len(rows), 0.5), 3)
        halves, half = [first, first], doc % 2
        for k in range(rounds):
            # a document's witness is chosen by the model of the other half, which cannot know it by heart
            z = np.where(half == 0, odds(halves[1], at, starts), odds(halves[0], at, starts))
            order = np.lexsort((-z, doc))
            top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
            # reviewers err: a harmful label without any likely witness and a harmless one with a certain one are left out
            witness = top[(label[doc[top]] == 1) & (z[top] > doubt[k])]
            wrong = doc[top[(label[doc[top]] == 0) & (z[top] > certain[k])]]
            rows = np.concatenate([witness, np.flatnonzero((label[doc] == 0) & ~np.isin(doc, wrong))])
            worst, held = z[top], label[doc[top]]  # scores by the model of the other half
            part = [rows] if k == rounds - 1 else [rows[half[rows] == i] for i in (0, 1)]
            halves = [train(r, label[doc[r]], np.where(label[doc[r]] == 1, positive, 1.0), 4 + 4 * (k == rounds - 1)) for r in part]
        w = halves[0]
        return w, cut(worst, held)
    return w, 0.0


def cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """A threshold in the widest gap among those that err least on labelled scores, which are of documents the model had not seen.

    Harmless documents are far more common outside the sample, so the highest of them lies higher there: the
    threshold is put towards the upper end of the gap.
    """
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum((y == 0)[::-1])])[::-1]  # below: harmful missed; above: harmless taken
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(edges[best + 1] - edges[best])]
    return float(0.15 * edges[at] + 0.85 * edges[at + 1])


def labelled(docs: DataFrame, labels: DataFrame, most: int, segs) -> list:
    """Segments (by the function segs of a text column) and majority label of at most so many labelled documents, drawn by a hash of the id; ties and nulls are left out."""
    voted = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m != 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.where(F.col("text") != "").select("doc_id", "text").join(F.broadcast(voted), "doc_id")
    rows = spread(picked).select("doc_id", "m", segs("text").alias("segs")).toPandas().sort_values("doc_id", kind="stable")  # bounded by most
    return [(list(map(list, t)), int(m > 0.5)) for t, m in zip(rows["segs"], rows["m"])]


def score(docs: DataFrame, labels: DataFrame, columns: list[str], most: int = 20_000) -> DataFrame:
    """columns of docs with score (log-odds of the worst segment) and harmful (1 or 0), a row per document.

    docs has doc_id and text; labels has doc_id and toxic. The model is fitted on at most `most` labelled
    documents; the language model counts all. Null, empty and wordless texts have the score -20. Repeated
    documents are scored alike.
    """
    spark = docs.sparkSession
    ship(spark)
    lm = language_model(docs, "text")
    words = [w for k in ("insult", "curse", "sexual", "threat", "group") for w in WORDS[k]]
    channel = spark.sparkContext.broadcast((lm, words))  # size fixed by the alphabet

    @F.pandas_udf("array<array<string>>")
    def restored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from skein.llm.harm import segments
        from skein.llm.restore import Restorer

        restorer = Restorer(*channel.value)
        for b in batches:
            yield pd.Series([segments(t, restorer) for t in b], dtype=object, index=b.index)

    weights, threshold = fit(labelled(docs, labels, most, restored))
    sent = spark.sparkContext.broadcast((lm, words, weights.astype(np.float32)))  # sizes fixed by alphabet and hash

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from skein.llm.harm import Features, odds, segments
        from skein.llm.restore import Restorer

        model, listed, w = sent.value
        restorer, feats = Restorer(model, listed), Features()
        for b in batches:
            segs, owner = [], []
            out = np.full(len(b), -20.0)
            for i, t in enumerate(b):
                if t:
                    own = segments(t, restorer)
                    segs += own
                    owner += [i] * len(own)
                if len(segs) > 4000 or i == len(b) - 1 and segs:
                    np.maximum.at(out, owner, odds(w, *feats.matrix(segs)))
                    segs, owner = [], []
            yield pd.Series(out)

    got = spread(docs.select(*dict.fromkeys([*columns, "text"]))).select(*columns, F.explode(F.array(worst("text"))).alias("score"))
    return got.withColumn("harmful", (F.col("score") > threshold).cast("int"))


def rates(scored: DataFrame, source) -> DataFrame:
    """Documents, harmful documents and their rate per source."""
    return scored.groupBy(source.alias("source")).agg(F.count("*").alias("docs"), F.sum("harmful").alias("harmful"), F.round(F.avg("harmful"), 6).alias("rate"))
