"""Personal information in free text: found by a skip-chain conditional random field, replaced by placeholders.

Texts are cut into tokens; addresses of mail, long numbers and codes are one token each. Neighbouring
tokens share transition potentials; repeated and similar tokens of a text share skip potentials, however
far apart they stand; loopy sum-product message passing runs until the messages have converged, so a
name that one mention makes plain is found in its other mentions. Which tokens can belong to an item at
all is told by their shape (capitals in a row, initials, numbers beside capitals, other scripts): word
lists are only features and add candidates written small. The field is fitted by pseudo-likelihood on
generated text, as there are no labels; no name, street or sentence of it comes from the data.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import Workspace, ship, spread

LABELS = ["O", "email", "phone", "id_number", "B-address", "I-address", "B-name", "I-name"]
#: Last labels of domains that people have their mail under; others are one feature.
_TOP = set("com net org edu gov int mil io dev app info biz name me co uk us ca au nz de at ch fr be nl es pt it pl cz se no dk fi ru ua gr tr br mx ar cl in jp cn kr eu test example invalid localhost local internal".split())
_KIND = ["", "email", "phone", "id_number", "address", "address", "name", "name"]
_Y = len(LABELS)

#: Word lists of the operator, all parameters. Given names: the commonest of the last century in some countries, from public registers.
GIVEN = set(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony sandra mark margaret donald ashley steven kimberly andrew emily paul donna joshua michelle kenneth carol kevin amanda brian melissa george deborah "
    "peter wolfgang klaus manfred helmut juergen heinz gerhard andreas hans josef guenter dieter horst walter frank bernd karl ursula monika sabine renate helga karin brigitte ingrid erika andrea gisela claudia susanne gabriele christa birgit heike martina angelika "
    "jean pierre michel andre philippe rene alain jacques bernard marcel claude henri christian nicolas marie jeanne francoise monique catherine nathalie isabelle jacqueline sylvie suzanne helene christine "
    "antonio manuel jose francisco javier carlos jesus alejandro miguel rafael pedro angel pablo maria carmen ana laura cristina marta dolores pilar "
    "mohamed ahmed ali fatima wei li hiroshi kenji raj priya amit ivan olga sergei natalia giovanni giuseppe krzysztof lars erik sofia anna".split()
)
TITLES = set("mr mrs ms miss dr prof herr frau hr fr mme mlle monsieur madame m sr sra srta senor senora don dona sir".split())
PARTICLES = set("von van de der den del della di da dos la le du el al bin ibn zu ter".split())
STREET = set("street st road rd avenue ave lane ln drive dr court ct way close crescent terrace boulevard bd blvd rue chemin impasse quai allee place square strasse str weg gasse ring platz damm ufer calle avda avenida plaza paseo camino carrer via".split())
UNIT = set("flat apt apartment unit suite app appartement piso wohnung room".split())
MACHINE = set("git deploy dev root admin noreply no-reply bot ci build postgres ubuntu ec2-user jenkins runner support info service daemon".split())
#: Street and unit words that are everyday words when written small.
_CAPITAL_ONLY = set("way close court ct drive dr place square st via carrer ring damm ufer weg unit suite app piso room wohnung apartment square platz quai terrace crescent flat".split())
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯؀-ۿ֐-׿ऀ-ॿ]")
_ELIDED = re.compile(r"[A-Za-z]{1,2}['’][a-zà-ÿ]")
_STREET_END = re.compile(r"(?:str|strasse|weg|gasse|allee|platz|ring|damm|ufer)$")

_Z = "​‌‍⁠﻿­"
_LABEL = rf"(?:[^\W_]|[{_Z}])(?:[^\W_]|[{_Z}-])*"
_PLAIN_AT = rf"(?:[ \t]?[{_Z}]*[@＠][{_Z}]*\s?|&#0*64;|&commat;|%40|\\u0040)"
_SAID_AT = r"(?:_(?:at|AT)_|[ ]?[\[({<][ ]?(?:at|AT|At|arroba)[ ]?[\])}>][ ]?|[ ]+(?:at|AT)[ ]+)"
_DOT = r"(?:\.|&#0*46;|[ ]?[\[({<][ ]?(?:dot|DOT|punkt|point|punto)[ ]?[\])}>][ ]?|[ ]+(?:dot|DOT)[ ]+)"
_SAID_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|DOT|punkt|point|punto)[ ]?[\])}>][ ]?|[ ]+(?:dot|DOT)[ ]+)"
_X = r"(?:\s*(?:x|[Ee]xt\.?|poste|Durchwahl|extension)\s?\d{1,5}\b)?"
_S = r"[\s.\-–‑/]"
_AT = re.compile(rf"(?P<plain>{_PLAIN_AT}){_LABEL}(?:{_DOT}{_LABEL})+|(?P<said>{_SAID_AT})(?=[A-Za-z]){_LABEL}(?:{_SAID_DOT}{_LABEL}|\.{_LABEL})+")
_HINT = re.compile(r"[@＠]|\b(?:at|AT|At|arroba)\b|_(?:at|AT)_|&|%40|\\u0040")
_LOCAL = re.compile(rf"[\w.+\-{_Z}]")
_TOKEN = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in [
            ("PLAIN", r"(?<![\w.$/:\\-])[a-z]{3,}+(?=\s|[,;.!?](?:\s|$)|$)"),  # most words: nothing else begins so
            ("CODE", r"(?<![A-Za-z])[A-Za-z]++://\S+|\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{7,}\b|`[^`\n]*+`|\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b|\d{1,2}:\d\d(?::\d\d(?:\.\d+)?)?|\d{1,3}(?:\.\d{1,3}){3}\b|\d{4}-\d\d-\d\d\S*|(?<![\w.$\-])(?=[\w.$-]*+(?:::|\\))[\w.$-]+(?:::|\\)[\w.:$\\-]*[\w/.]*|(?<![\w.$\-])[\w.$-]*?[A-Za-z0-9]_[\w.:$-]*[\w/.]*|(?<![\w/.\-])\w++(?:/[\w.\-]++)+(?<=[A-Za-z])(?=\W|$)"),
            ("INT", rf"(?<![\w+])\+\d{{1,3}}(?:{_S}?\(?\d{{1,5}}\)?){{1,6}}{_X}(?!\w)|(?<![\w.])(?=(?:{_S}?\d){{10}})(?!\d{{11}}(?!\w))00[1-9]\d{{0,2}}(?:{_S}?\d{{2,4}}){{2,6}}{_X}(?!\w)"),
            ("NANP", rf"(?<![\w+.])\(\d{{3}}\){_S}?\d{{3}}{_S}\d{{4}}{_X}(?![\w-])|(?<![\w+.\-])\d{{3}}{_S}\d{{3}}{_S}\d{{4}}{_X}(?![\w-])"),
            ("INSEE", r"(?<![\w+.\-])[12][\s.\-]?\d\d[\s.\-]?\d\d[\s.\-]?(?:\d\d|2[AB])[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d\d(?!\w)"),
            ("SSN", r"(?<![\w+.\-])\d{3}[\s.\-–‑]\d{2}[\s.\-–‑]\d{4}(?![\w-])"),
            ("TAX", r"(?<![\w+.\-])\d\d[\s.\-]\d{3}[\s.\-]\d{3}[\s.\-]\d{3}(?!\w)|(?<![\w+.\-])\d{11}(?!\w)"),
            ("LOCAL", rf"(?<![\w+.\-])0\d(?:{_S}\d\d){{4}}(?!\w)|(?<![\w+.\-])(?:\(0\d{{1,4}}\)|0\d{{1,4}}){_S}\d{{3,8}}(?:{_S}\d{{2,4}}){{0,3}}{_X}(?!\w)"),
            ("CARD", r"(?<![\w+.\-])(?:[XYZ][\s.\-]?\d{7}[\s.\-]?[A-Z]|\d{1,2}\.?\d{3}\.?\d{3}[\s.\-]?[A-Z]|[A-Z]{2}[\s.\-]?\d\d[\s.\-]?\d\d[\s.\-]?\d\d[\s.\-]?[A-D]|[a-z]{2}[.\-]?\d\d[.\-]?\d\d[.\-]?\d\d[.\-]?[A-Da-d]|(?=[A-Z]{1,9}\d)[A-Z][0-9A-Z]{7,9})(?!\w)"),
            ("LONG", r"(?<![\w+.])\d{7,}+(?!\w)|(?<![\w+.])\d++(?:[.\-–]\d++){2,}+(?!\w)"),
            ("INITIAL", r"(?<!\w)(?<!\w['’])[A-ZÀ-Ý]\.(?=[\s-])"),
            ("WORD", r"(?:[^\W\d_][\u0300-\u036f]*+)++(?:['’\-](?!s\b)(?:[^\W\d_][\u0300-\u036f]*+)++)*"),
            ("NUM", r"\d+(?:[a-zA-Z]\b)?"),
            ("SIGN", r"[^\w\s]"),
        ]
    )
)
_NUMBERS = {"INT", "NANP", "INSEE", "SSN", "LOCAL", "CARD", "TAX", "LONG"}


def bare(w: str) -> str:
    w = w.lower()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w.replace("ß", "ss")) if not unicodedata.combining(c))


def mails(text: str) -> list[tuple[int, int]]:
    """Spans that read as addresses of mail: found from the sign between, whatever the length of what stands before it."""
    out, end = [], 0
    if not _HINT.search(text):
        return out
    for m in _AT.finditer(text):
        a = m.start()
        while a > end and _LOCAL.match(text[a - 1]) and text[a - 4 : a].lower() != "_at_":
            a -= 1
        while a < m.start() and not (text[a].isalnum() or text[a] == "_"):
            a += 1
        if a < m.start():
            out.append((a, m.end()))
            end = m.end()
    return out


def lex(text: str) -> list[tuple[int, int, str, str]]:
    """Tokens as (start, end, kind, text) in code points. What begins earlier holds: an address within a link is part of the link."""
    out, spans, k, end = [], mails(text), 0, 0
    for m in _TOKEN.finditer(text):
        s = m.start()
        while k < len(spans) and spans[k][0] <= s:
            if spans[k][0] >= end:
                out.append((*spans[k], "EMAIL", text[spans[k][0] : spans[k][1]]))
                end = spans[k][1]
            k += 1
        if s >= end:
            out.append((s, m.end(), "WORD" if m.lastgroup == "PLAIN" else m.lastgroup, m.group()))
            end = m.end()
    return out


_flags_memo: dict[str, str] = {}


def flag(kind: str, w: str) -> str:
    """What a token is by the lists: the alphabet of the contextual features."""
    if kind != "WORD":
        return kind
    got = _flags_memo.get(w)
    if got is None:
        b = bare(w)
        parts = b.split("-")
        cap = w[0].isupper() or ("-" in w and any(p[:1].isupper() for p in w.split("-")))  # el-Something
        if all(p in GIVEN for p in parts):
            got = "given" if cap else "lowgiven"
        elif b in TITLES and (cap or len(b) > 2):
            got = "title"
        elif cap and not w.isascii() and unicodedata.name(w[0], "").split(" ")[0] not in ("LATIN", "MODIFIER") or _WIDE.match(w):
            got = "script"
        elif _ELIDED.match(w):
            got = "low"
        elif not cap and b in _CAPITAL_ONLY:
            got = "low"
        elif b in STREET or (_STREET_END.search(b) and len(b) > 5 and cap):
            got = ("street" if cap else "lowstreet") + ("end" if b not in STREET else "")
        elif b in UNIT:
            got = "unit" if cap else "lowunit"
        elif not cap and b in PARTICLES or b.split("'")[0] in ("d", "l"):
            got = "particle"
        else:
            got = "upper" if w.isupper() and len(w) > 1 else "cap" if cap else "low"
        if len(_flags_memo) < 300_000:
            _flags_memo[w] = got
    return got


class Numbers(dict):
    """Numbers of features while a field is fitted: a new one for each new feature; 0 is kept for what no field knows."""

    def __missing__(self, feature: str) -> int:
        n = self[feature] = len(self) + 1
        return n


#: Shares of all words from which a word of mail addresses counts as spelled by some and by many, and a word of the texts as known.
SPELLED, KNOWN = (1e-5, 1e-4), 1e-5


class Evidence:
    """What all texts together say of words: mail, those that mail addresses spell (1 some, 2 many); case, how known ones are written (1 mostly small, 2 both ways, 3 mostly with a capital)."""

    def __init__(self, mail: dict[str, int] | None = None, case: dict[str, int] | None = None):
        self.mail, self.case = mail or {}, case or {}
        self.held: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        """Levels of a word: by mail addresses, by case."""
        got = self.held.get(word)
        if got is None:
            b = bare(word)
            got = max(self.mail.get(x, 0) for x in b.split("-")), self.case.get(b, 0)
            if len(self.held) < 300_000:
                self.held[word] = got
        return got


def evidence(df: DataFrame, text: str) -> Evidence:
    """Evidence of all texts. Persons are named by their mail addresses, and what is mostly written small is no name.

    Words count from a share of all words on, so there are at most 100,000 of either kind whatever the data.
    """
    ws, made = Workspace(df.sparkSession), []

    def common(words: DataFrame, share: float, *sums) -> list:
        counts, _ = ws.write(words.groupBy("w").agg(F.count("*").alias("n"), *sums), f"words{len(made)}")
        made.append(counts)
        total = counts.agg(F.sum("n").alias("t"))  # one row
        return counts.join(F.broadcast(total)).where(F.col("n") >= F.col("t") * share).collect()  # at most 1 / share

    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    local = texts.where(F.col("t").contains("@")).select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(?<![\w.+-])([\w.+-]++)@"), 1)).alias("l"))
    mail = common(local.select(F.explode(F.split("l", r"[^\p{L}]+")).alias("w")).where("length(w) > 2"), SPELLED[0])
    total = sum(r["n"] for r in mail)
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{N}_.@/+\-])\p{L}\p{Ll}++(?![\p{L}\p{N}_@/])"), 0)).alias("x"))
    case = common(words.select(F.lower("x").alias("w"), (F.lower("x") == F.col("x")).cast("long").alias("s")), KNOWN, F.sum("s").alias("s"))
    return Evidence(
        {r["w"]: 1 + (r["n"] >= total * SPELLED[1] and r["n"] > 2) for r in mail if r["w"] not in MACHINE},
        {bare(r["w"]): 1 if r["s"] > 0.7 * r["n"] else 3 if r["s"] < 0.1 * r["n"] else 2 for r in case if r["n"] > 2},
    )


_NAMED = ("cap", "given", "script", "upper", "street", "streetend", "unit", "title")


def candidates(toks, flags: list[str], text: str, level: list[int]) -> list[int]:
    """Numbers of the tokens that can belong to an item, by shape; lists only add what is written small.

    Capitals in a row (with particles, a comma or initials between), what stands beside an initial, a title
    or a word of another script, numbers with capitals beside them and all between, long numbers, addresses of
    mail; and every other mention of a word so found.
    """
    n = len(toks)
    can = bytearray(n)
    last, between = -1, 0
    for i, f in enumerate(flags):
        if f == "EMAIL" or f in _NUMBERS:
            can[i] = 1
            for j in range(max(0, i - 4), min(n, i + 4)):  # who it belongs to may be written small
                can[j] |= flags[j] in ("low", "particle")
        elif f in ("given", "lowgiven", "title", "INITIAL", "script"):
            for j in range(max(0, i - 3), min(n, i + 6)):
                can[j] = 1
        elif f in ("street", "streetend", "unit", "lowstreet", "lowunit", "lowstreetend"):
            for j in range(max(0, i - 6), min(n, i + 7)):
                can[j] = 1
        elif f == "NUM":
            near = [j for j in range(max(0, i - 3), min(n, i + 4)) if flags[j] in _NAMED]
            if near:
                for j in range(min(near[0], i), max(near[-1], i) + 1):
                    can[j] = 1
        if f in ("cap", "upper", "given"):
            if last >= 0 and "\n" not in text[toks[last][1] : toks[i][0]]:
                for j in range(last, i + 1):
                    can[j] = 1
            last, between = i, 0
        elif last >= 0 and (f == "particle" or toks[i][3] == ",") and between < 3:
            between += 1
        else:
            last = -1
    words = {toks[i][3] for i in range(n) if can[i] and flags[i] in ("cap", "given", "script") and len(toks[i][3]) > 2}
    last = -1
    for i in range(n):
        if toks[i][3] in words:
            can[i] = 1
        if level[i]:
            if last >= 0:
                for j in range(last, i + 1):
                    can[j] = 1
            last = i
        elif flags[i] != "particle" and toks[i][3] != ",":
            last = -1
    return [i for i in range(n) if can[i] and flags[i] != "CODE"]


def analyse(text: str, seen: Evidence, number) -> tuple[list, list[int], list[list[int]]]:
    """Tokens, the numbers of those that can belong to an item, and the features of these; number gives the number of a feature."""
    toks = lex(text)
    n = len(toks)
    flags = [flag(k, w) for _, _, k, w in toks]
    both = [seen.of(w) if k == "WORD" else _NOTHING for _, _, k, w in toks]
    level, case = [x for x, _ in both], [x for _, x in both]
    where = candidates(toks, flags, text, level)
    feats = []
    low = [t[3].lower() if t[2] != "EMAIL" else "@" for t in toks]
    at = lambda i: flags[i] if 0 <= i < n else "edge"
    wd = lambda i: (low[i] if flags[i] not in _NUMBERS else flags[i]) if 0 <= i < n else "edge"
    for i in where:
        s, e, k, w = toks[i]
        f = flags[i]
        p1, p2, n1, n2 = at(i - 1), at(i - 2), at(i + 1), at(i + 2)
        out = [f"f={f}", f"f{f}p{p1}", f"f{f}n{n1}", f"f{f}p{p2},{p1}", f"f{f}n{n1},{n2}", f"f{f}p{p1}n{n1}", f"p={wd(i - 1)},{f}", f"n={wd(i + 1)},{f}"]
        gap = "nl" if i and "\n" in text[toks[i - 1][1] : s] else "touch" if i and toks[i - 1][1] == s else "gap"
        out += [f"{gap},{f}", f"{gap},{f},{p1}"]
        if k == "WORD":
            b = bare(w)
            out += [f"e2={b[-2:]},{f}" if f in ("cap", "given", "upper") else f"e3={b[-3:]},{f}", f"w={b}", f"long={min(len(b), 9)},{f}", f"first={p1 in _ENDS_BEFORE or gap == 'nl'},{f},{n1}"]
            if f in ("street", "lowstreet", "unit", "lowunit", "particle", "title"):
                out += [f"w={b}p{p1}", f"w={b}n{n1}", f"w={b}n{n1},{n2}", f"w={b}p{p2},{p1}"]
            if p1 in ("street", "particle", "lowstreet", "unit", "title"):
                out.append(f"after={wd(i - 1)},{f}")
            if n1 in ("street", "streetend", "lowstreet"):
                out.append(f"before={wd(i + 1)},{f}")
            lv, lp, ln = level[i], level[i - 1] if i else 0, level[i + 1] if i + 1 < n else 0
            cs, cp, cn = case[i], case[i - 1] if i else 0, case[i + 1] if i + 1 < n else 0
            out += [f"k{cs},{f}", f"k{cs},{f},{cp},{p1}", f"k{cs},{f},{cn},{n1}", f"k{cs},{lv}"]
            out += [f"v{lv},{f}", f"v{lv},{lp},{f},{p1}", f"v{lv},{ln},{f},{n1}", f"v{lv},{lp},{ln}"]
            near = [at(j) for j in range(max(0, i - 4), min(n, i + 5)) if j != i]
            out += [f"near{f}:{x}" for x in ("given", "street", "lowstreet", "streetend", "title", "INITIAL", "NUM") if x in near]
        elif k == "NUM":
            out += [f"len={min(len(w), 6)}", f"len{len(w)}n{n1}", f"len{len(w)}p{p1}", f"abs{'street' in (n1, n2)}{'street' in (p1, p2)}"]
        elif k == "EMAIL":
            local = re.split(r"[@＠]|&|%40|\\u0040|_at_| ?[\[({<]| +(?:at|AT) +", w, maxsplit=1)[0]
            tail = re.split(r"[.\s]", w.lower().rstrip(")]}> "))[-1]
            out += [f"machine={local.lower().rstrip('0123456789-') in MACHINE}", f"tld={tail if tail in _TOP else '?'},{' @' in w}", f"after={text[e : e + 1] if text[e : e + 1] in ':/~' else '.'}", f"front={text[max(0, s - 1) : s] if text[max(0, s - 1) : s] in '/@' else '.'}", f"gap={' @' in w and '@ ' not in w},{w.count('.')}"]
            out += [f"c={x}" for x in {wd(j) for j in range(i - 3, i)}]
        elif f in _NUMBERS:
            shape = re.sub(r"\d+", lambda m: str(len(m.group())), w)
            digits = re.sub(r"\D", "", w)
            out += [f"shape={shape}", f"lead={digits[:2]},{f}", f"lead={digits[:1]},{shape}", f"n={len(digits)},{f}", f"555={'555' in digits[3:-3]},{f}", f"zero={digits[:3] in ('000', '666') or digits[:1] == '9'},{f}"]
            out += [f"c={x},{f}" for x in {wd(j) for j in range(i - 5, i)}] + [f"d={x},{f}" for x in {wd(j) for j in range(i + 1, i + 4)}]
            out += [f"g={x}" for x in {wd(j) for j in range(i - 4, i)}] + [f"gn{f}:{'given' in [at(j) for j in range(max(0, i - 8), min(n, i + 5))]}"]
        feats.append([number(x) for x in out])
    return toks, where, feats


#: Labels a kind of token can have, as penalties.
_ALLOWED = {"EMAIL": (0, 1), **dict.fromkeys(_NUMBERS, (0, 2, 3)), "WORD": (0, 4, 5, 6, 7), "INITIAL": (0, 4, 5, 6, 7), "NUM": (0, 4, 5), "SIGN": (0, 5, 7)}
_PENALTY = {k: np.array([0.0 if y in v else -1e4 for y in range(_Y)]) for k, v in _ALLOWED.items()}


_NOTHING = (0, 0)
#: What stands before the first word of a sentence.
_ENDS_BEFORE = ("edge", "SIGN")


def _chains(where: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring tokens, as positions in where."""
    out, a = [], 0
    for i in range(1, len(where) + 1):
        if i == len(where) or where[i] != where[i - 1] + 1:
            out.append((a, i))
            a = i
    return out


def _alike(k: str, w: str) -> list[str]:
    """Keys under which similar tokens meet: the word, its stem, its parts, and itself with any one letter left out."""
    b = bare(w)
    if k != "WORD":
        return [b]
    out = [b, *(p for p in b.split("-") if len(p) > 3 and p != b)]
    if len(b) > 4:
        out.append(b[:-2] if b.endswith("'s") or b.endswith("’s") else b[:-1] if b.endswith("s") else b + "'")
    if 6 <= len(b) <= 24:
        out += [f"{b[:i]}?{b[i + 1:]}" for i in range(1, len(b))]
    return out


def _skips(toks, where) -> list[tuple[int, int]]:
    """Pairs of positions in where whose tokens repeat or resemble each other, each with the next such one."""
    last, out = {}, set()
    for j, i in enumerate(where):
        _, _, k, w = toks[i]
        if k == "WORD" and len(w) > 2 and flag(k, w) in ("cap", "given", "lowgiven", "script", "upper") or k == "EMAIL" or k in _NUMBERS:
            for key in _alike(k, w):
                at = last.get(key)
                if at is not None and at != j:
                    out.add((at, j))
                last[key] = j
    return sorted(out)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def infer(unary: np.ndarray, chains: list[tuple[int, int]], skips: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray, skip: np.ndarray, rounds: int = 200, least: float = 1e-3) -> np.ndarray:
    """Label marginals of all tokens: chains are passed exactly, skip edges by loopy messages between rounds.

    Rounds end when no message changes by `least`, or at the latest after `rounds`, since loops may oscillate.
    After the first only chains with a skip edge are passed again.
    """
    n = len(unary)
    joined = np.zeros(n + 1, bool)
    joined[skips.ravel()] = True
    extra = np.zeros_like(unary)
    msg = np.zeros((len(skips), 2, _Y))
    groups: dict[int, list] = {}
    for a, b in chains:
        groups.setdefault(1 << (b - a - 1).bit_length() if b - a > 1 else 1, []).append((a, b))
    padded = []
    for width, cs in groups.items():
        idx = np.full((len(cs), width), n)
        for r, (a, b) in enumerate(cs):
            idx[r, : b - a] = np.arange(a, b)
        padded.append((idx, idx < n))
    belief = np.zeros_like(unary)
    for r in range(rounds if len(skips) else 1):
        if r == 1:
            padded = [(idx[on], live[on]) for idx, live in padded if (on := (joined[idx] & live).any(1)).any()]
        node = np.vstack([unary + extra, np.zeros((1, _Y))])
        for idx, live in padded:
            u = node[idx]
            width = idx.shape[1]
            fwd, bwd = np.zeros_like(u), np.zeros_like(u)
            length = live.sum(1)
            fwd[:, 0] = u[:, 0] + start
            for t in range(1, width):
                fwd[:, t] = u[:, t] + _lse(fwd[:, t - 1, :, None] + trans, 1)
            rows = np.arange(len(idx))
            bwd[rows, length - 1] = end
            for t in range(width - 2, -1, -1):
                on = t < length - 1
                bwd[on, t] = _lse(trans + (u[on, t + 1] + bwd[on, t + 1])[:, None, :], 2)
            b = (fwd + bwd)[live]
            belief[idx[live]] = b - _lse(b, 1)[:, None]
        if len(skips):
            new = np.empty_like(msg)
            for d in (0, 1):
                out = belief[skips[:, d]] - msg[:, 1 - d]
                m = _lse(out[:, :, None] + skip, 1)
                new[:, d] = m - m.max(1, keepdims=True)
            if np.abs(new - msg).max() < least:
                break
            msg = 0.5 * msg + 0.5 * new
            extra = np.zeros_like(unary)
            np.add.at(extra, skips[:, 1], msg[:, 0])
            np.add.at(extra, skips[:, 0], msg[:, 1])
    return belief


# ---- training text -------------------------------------------------------------------------------

# Contexts of the training generator, written for it. {N} name, {E} mail, {P} phone, {I} identity number, {A} address, {M} the family name
# of a person named before; lower case: what only looks like an item, or filling; ¶ a line end. [a/b] is one of the alternatives.
CONTEXTS = """[Could you/Can you/Would you mind to] check with {N} [first/again/before Friday]?|{N} [reviewed/approved/rejected/wrote/tested/merged/broke/left] [it/this/that part/my change/the {w} module]{t}|[Approver/Reporter/Maintainer/Contact/Manager/Translator/Lead]: {N}|[approved/tested/reported/suggested/found]-by: {N} <{E}>|[From/To/Bcc/Reply-To]: {N} <{E}>
[Yours/Cheers/Many thanks/Best wishes/Sincerely],¶{N}|[Cheers/Yours], {N} / {E}|this is {N}, my number is {P}|[ring/phone/text/dial] {N} on {P} after lunch|{N} is [away/out/on leave/back] until {d}|a question for {N}|[talked/spoke] to {N} [about/regarding] the {w}|[according to/says] {N}|[with/without/from/for/to/by/and/like] {N}{t}|[told/asked/paid/called/emailed] {N} [twice/yesterday/at noon]|{N}: [ok/done/yes/no, thanks/will look]|{N} [thinks/believes/says/claims] the {w} is [fine/wrong/slow]. {M} [should/may] know [more/why].
{N} [moved/relocated] to {A}{t}|[our/her/his/their] [home/office/mailing] address is {A}{t}|[post/mail/forward/return] [it/the parcel/the box/the letter] to {A}{t}|[billing/delivery/home] address: {A}|[Pick up at/Meet at/Sent to] {A}{t}|[street/addr/address]={A}|"[address/street/residence]": "{A}"|{N}¶{A}|{N}, {A}|[Die Lieferung/Der Brief/Die Karte] [ging/kommt] an {A}{t}|[Meine/Ihre/Seine] Adresse [ist/lautet] {A}{t}|[wohnt/lebt/arbeitet] [in/bei] {A}{t}|[Mon/Son/Notre] adresse est {A}{t}|[habite/réside] au {A}{t}|[Le courrier/La lettre] part pour {A}{t}|[Mi/Su] dirección es {A}{t}|[vive/reside] en {A}{t}|[La carta/El pedido] llegó a {A}{t}
[Rückfragen bitte an/Das hat/Gespräch mit/Danke an/Grüße von/Freigabe durch] {N}{t}|{N} [hat das geprüft/meint, es sei fertig/ist im Urlaub/kennt den Grund]{t}|[Parle à/Merci à/Réunion avec/Validé par/Selon] {N}{t}|{N} [a relu/pense que c'est bon/est en congé/connaît la cause]{t}|[Habla con/Gracias a/Reunión con/Aprobado por/Lo dijo] {N}{t}|{N} [lo revisó/cree que está bien/está de vacaciones/conoce la causa]{t}
[mail/write/ping/remove/ask/try/send it to/forward to/copy/notify/invite/subscribe] {E}{t}|[account/user/login/email/recipient/owner]: {E}|[account/login/email]="{E}"|"[email/mail/contact]": "{E}"|?[email/user/to]={E}&{w}=1|[no account/invitation sent/password reset] for {E}{t}|{E} [bounced/unsubscribed/signed up/never replied]{t}|[Meine Mail/Mein Postfach] ist {E}{t}|[Mon courriel/Ma boîte] : {E}|[Mi correo/Mi buzón] es {E}{t}|<{E}>|{E}, {E}|{E}
[my/her/his/the direct] [phone/mobile/cell/number/line] is {P}{t}|[reach/call/text/phone/ring] [me/him/her/us] [at/on] {P}{t}|[phone/mobile/cell/tel/fax/whatsapp]: {P}|[phone/mobile/tel]="{P}"|"[phone/mobile/tel]": "{P}"|Tel. {P}|tel:{P}|[Handy/Telefon/Durchwahl/Rückruf unter] {P}{t}|[Mein Anschluss ist/Erreichbar unter] {P}{t}|[téléphone/portable/Joignable au/Rappelle-moi au] {P}{t}|[teléfono/móvil/Mi fijo es/Llama al] {P}{t}|{P} ([home/work/mobile])|{P}
[social security number/national insurance number/passport/passport number/driving licence/driver licence/driver's license/identity card/tax number/SSN/NINO/TIN]: {I}|[my/her/his] [SSN/social/passport/licence number/tax id] is {I}{t}|[ssn/passport/id_card/tax_id]={I}|"[ssn/passport/taxId/document]": "{I}"|[Steuernummer/Steuer-ID/IdNr./Ausweis/Personalausweis/Reisepass/Identifikationsnummer] {I}{t}|[numéro de sécu/carte nationale/carte nationale d'identité/pièce d'identité/passeport/NIR] {I}{t}|[DNI/NIE/pasaporte/documento de identidad] {I}{t}|[holder of/issued] [document/card/passport] {I}{t}|{N} ({I})|{N}, [born/geboren/né/nacido] {d}, {I}|[a real/an actual/somebody's] [SSN/passport number/tax id] [leaked/is in the log/is in the dump]: {I}
{N}¶{P}¶{E}|{P}¶{E}|{E}¶{P}|{I} / {N}|{N} / {I}|{N} - {P}|{N};{E};{P}|{N},{E},{P}|{w},{N},{E}|("{N}", {I})|({I}, '{N}', '{A}')|{N}\t{P}\t{A}|('{N}', '{E}', '{P}')|VALUES ('{N}', '{I}', '{A}')|"[name/fullName/customer]": "{N}", "[eMail/post]": "{E}"|[name/customer/author/assigned]="{N}"|{{"person":"{N}","id":"{I}","home":"{A}","tel":"{P}"}}|- {N} ({P})|* {N} <{E}>|{N} | {P} | {I}|[patient/tenant/client/driver/employee/student] {N}{t}|N:{N}|TEL:{P}|EMAIL:{E}|ORG;{N};{A}|{N}|{A}
[Ask/Laut/Ping/Per/Nach/Mit/Von/Für/Durch/Wegen/Avec/Chez/Pour/Par/Selon/Según/Con/Para/Por/Via/See/Thank/Thanks/Meet/Call/Hi/Hello/Dear/Hallo/Liebe/Bonjour/Cher/Hola/By] {N}{t}|[ask/ping/hi,/hey,/hello/from/by/mit/von/para/avec/chez/que/daß/dass/und/and/y/et/or] {N} [here/again/today/first/bitte/heute/merci/hoy]{t}|{N} [is/was/has/had/will/can/hat/ist/wird/a/est/va/es/ha] [here/there/one/it/ready/da/fertig/là/aquí/ya]{t}|[log/blame/history/diff] [says/shows] {N} [did it/touched it]{t}|{k} {N}{t}|{k} {N} [said/left/noted/agreed/sagte/fehlt/dit/part/dijo/sale]{t}|{k} {f} {N}{t}|{f} {N}{t}|{f} {N} {f}|{f} {N}, {f}|{N} {f}|{f} {E} {f}|{f} {E}{t}|{k} {f} {E} {f}|{k} {E}|{f} {A}{t}|{f} {A} {f}|{k} {f} {A}{t}|{f} {N}, {A}|{N} {f} {A}|{u} {u} [is/was] the [title/nickname/label/heading] for {f}|the [project/product/service/release/package/plan/ship/town/tool] {u} {u} {f}|[called/named/codenamed/labelled/entitled] {u} {u}|{W} {W} [is/was/has/will/and] {f}|{N}'s [idea/patch/change/laptop/calendar/branch]{t}|[by/per/via] {N}'s [wish/order/mail]|[Author/Committer/owner/assignee/Developer/holder/lead/user/who]: {N}¶|[Author/owner/holder/lead/user/who]: {N}{t}|({N})|[the author/its owner/my colleague/the tenant/un collègue/mein Kollege/mi colega], {N}, [left/agreed/said so/meint ja/est parti/se fue]{t}
[ticket/case/issue/bug/PR/incident] {s} [is open/was closed/got merged]|[order/invoice/booking/shipment/part] [no./ref] {p} [shipped/failed]|[item/sku/model/asset] {s}|[build/run/job/pipeline/release] {b} [passed/failed/took {n} s]|[offset/epoch/seed/token/pid/row/size/bytes/span] {l} [of/at/in] {n}|[offset/epoch/seed/token/pid/salt/nonce/port/x/y/id] = {l}|{n}.{n} {n}, [seed/salt/x] = {l}|[checksum/digest/hash/commit/sha] {h} [ok/bad/changed]|[serial/batch/component/error code/chip] {c}|v{v} [is out/breaks it/needs {v}]|[upgrade/downgrade] from {v} to {v}|[range/span/interval/between] [{z}/{p}] [of/in/and] the {w}|[dates/lines/ports] {n}-{n}|[tracking/account/register] {l}|{p} [rows/bytes/records] scanned|{s} {s} {s}
[property/route/inject/given] @{w}.{w} [is/was/on] {w}|[cloned/fetched/pushed] {g}|[ssh/scp/rsync] {m}{o}|{m}:~[$/%] ls|[npm/pnpm/yarn] add @{w}/{w}@{v}|@{w}.{w} decorator|uses: {w}/{w}@v{n}|{w}@{n}x.png|[ping/cc] @{w} and @{w}-{w}|{w}://{w}:{w}@{w}.{w}:{n}/{w}|[noreply/no-reply/donotreply]@{w}.example|[queue/topic] {w}@{n}
[Lane/Drive/Road/Court/Place/Square/Street/Flat/Unit/Suite] {n} [of the/in the/is] {w}|{n} [Road/Street/Avenue/Court] [signs/works] [closed/ahead]|[Platz/Straße/Ring/Weg/Allee] {n} [im/ist/fehlt] {W}|[Place/Rue/Allée/Chemin] {n} [du/est] {w}|[Calle/Plaza/Vía] {n} [del/es] {w}|{n} {W} {W}{t}|{n} {W}{t}|{W} {n}{t}|{W} {n}, {W} {n}|[nach/in/von/mit] {n} {W} [im/am/und] {W}|{W} {n}: {W} {W}|[with/by/to/avec/mit/con/de/from] {n}. {k} {f}|{n}. {k} {f}|[port/host]:{n} {k} {f}|0x{h} {f}"""
#: Later mentions of a person by the family name alone.
MENTIONS = """{M} [said/says/explained/wrote/left/agreed/knows/fixed/wants/sagte/weiß/ging/a dit/dit/veut/dijo/quiere/sabe] {f}|{k} {M} [said/left/agreed/knows/ging/dit/dijo] {f}|{f} {M}{t}|{f} {M} {f}|[ask/tell/thank/call/with/for/by/to/von/mit/für/avec/pour/à/con/para] {M}{t}|[Ask/Tell/Thank/With/Mit/Von/Avec/Con] {M} {f}|{M}'s [idea/part/patch] {f}|{k} {f} {M}{t}|{M}: {f}|{M} [is/was/has/ist/hat/est/a/es/ha] {f}"""
# Filling: sentences made of these words, language by language: small words, nouns, verbs.
_WORDS = {
    "en": ("the a this that my each no some in on for with after before about".split(), "cache queue file test build branch index token thread schema server client table column field record parser buffer model script result value error warning change request review module folder log disk user page".split(), "fails works hangs returns needs breaks drops reads writes loads skips moves holds looks seems stays".split()),
    "de": ("der die das ein eine mit nach vor auf für und im".split(), "Zwischenspeicher Datei Prüfung Zweig Verzeichnis Faden Tabelle Spalte Feld Satz Fehler Warnung Änderung Anfrage Seite Zeile Wert Ergebnis Dienst Rechner Modell Skript Stelle Woche Stunde Sekunde Eintrag Ordner".split(), "läuft fehlt hängt liefert braucht bricht liest schreibt lädt bleibt endet wächst".split()),
    "fr": ("le la un une ce avec après avant pour dans sur".split(), "cache fichier test branche index jeton fil schéma serveur client table colonne champ ligne erreur valeur page dossier journal disque modèle résultat requête".split(), "échoue marche bloque renvoie casse lit écrit charge reste finit manque".split()),
    "es": ("el la un una este con para antes de en sobre".split(), "archivo prueba rama índice hilo esquema servidor cliente tabla columna campo fila error valor página carpeta registro disco modelo resultado consulta".split(), "falla funciona espera devuelve rompe lee escribe carga queda termina falta".split()),
}
#: Words that begin sentences in the four languages.
_BEGIN = "As When If Since While Because Although Please Ask Tell Let Did Does Has Is Was Can So But And Yes No Maybe Today Yesterday Only Even Both Also Dear Hello Hi Thanks Cheers Regards Greetings Wenn Weil Als Ob Bitte Danke Laut Nach Mit Von Hat Ist Heute Gestern Nur Auch Liebe Lieber Hallo Grüße Quand Si Comme Selon Avec Pour Par Chez Merci Bonjour Cher Aujourd'hui Hier Seul Cuando Como Según Con Para Por Gracias Hola Querida Hoy Ayer Solo También".split()
#: Words that begin sentences, headings and names of things; none names a person.
_TITLED = "Please Why How What When Where If The This That It We You They Note Hint Warning Error Step Part Done Fixed Added Removed Next First Second Finally Also But So And Then Here There Now See Use Run Set Make Check Try Add Move Open Close Read Write Load Save Send Get Put Bitte Warum Wenn Wie Was Danach Zuerst Hier Jetzt Noch Kein Nur Auch Aber Pourquoi Quand Comment Ensuite Ici Puis Mais Aucun Por Cuando Como Luego Aqui Pero Ninguno Hay Data Lake Machine Learning Visual Basic Open Source Pull Request Merge Conflict Unit Test Null Pointer Stack Trace Memory Leak Garbage Collector Thread Pool Hash Map Linked List Binary Tree Load Balancer Access Denied Not Found Internal Server Bad Gateway Time Out Key Value Store Service Level Agreement Design Document Release Notes Change Log Table Contents User Guide Quick Start Known Issues New York San Francisco United States Great Britain South Africa North Sea Monday Tuesday Friday January March August Linux Windows Docker Python Java Rust Spark Kafka Redis Postgres Chrome Firefox Android Silver Golden Amber Scarlet Crimson Indigo Violet Emerald Ivory Cobalt Falcon Heron Otter Badger Tiger Panther Raven Sparrow Salmon Dolphin Maple Cedar Willow Orchard Meadow River Harbor Gate Tower Bridge Stone Iron Copper Winter Summer Autumn Storm Thunder Cloud Comet Orbit Nova Titan Phoenix Delta Sigma Omega".split()
_END = ["son", "sen", "mann", "berg", "er", "ez", "ski", "ova", "ov", "ini", "etti", "ier", "ard", "ic", "oglu", "wala", "ley", "ton", "ford", "strom", "vist", "lund", "aux", "eau", "ides", "akis", "enko", "yan", "dze", "zade", "awa", "moto", "nen", "ga", "o", "a", "i", "e", "s", "t", "n", "l"]
_GIVEN_END = ["a", "o", "e", "i", "ia", "us", "as", "el", "in", "an", "on", "ette", "ine", "ard", "ert", "win", "ka", "ko", "u", "h", "y", "is", "le", "ne", "ra", "id", "im"]
_TOWN_END = ["ton", "ford", "ham", "burg", "stadt", "hausen", "ville", "court", "mont", "bourg", "ada", "illa", "edo", "ona", "mouth", "port", "haven", "dorf", "heim", "wick", "by", "ach"]
_ITEM = re.compile(r"\{(\w)\}")
_CHOICE = re.compile(r"\[([^\[\]]*/[^\[\]]*)\]")


_ONSETS = "b br bl c ch cl cr d dr f fl fr g gl gr gw h j k kl kr l m n p ph pl pr qu r rh s sc sch sh sl sm sn st sw t th tr v vl w wh y z zh".split() + [""] * 6
_VOWELS = "a e i o u a e i o u a e i o u y ai au aw ay ea ee ei ew ey ia ie io oa oe oo ou ow oy ua ue ui ö ü ä é è á í ó ú ø å".split()
_CODAS = "b c ck d ff ft g gh h k kt l ld lk ll lt m mb n nd ng nk nt p r rd rk rn rs rt s sh sk ss st t th tt tz v w wn x z".split() + [""] * 30


class Writer:
    """Writes labelled training text. Names, streets and towns are made of random syllables, or taken from GIVEN."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = sorted(GIVEN)
        plain = [w for k, x in _WORDS.items() for w in x[0] + x[2] + (x[1] if k != "de" else [])] + [w.lower() for w in _BEGIN + _TITLED]
        written = lambda w, small: 1 if self.r.random() < small else 3 if self.r.random() < 0.4 else 2 if self.r.random() < 0.2 else 0
        self.seen = Evidence({bare(w): 1 for x in _WORDS.values() for w in x[1] + x[2] if self.r.random() < 0.03}, {bare(w): written(w, 0.6) for w in plain} | {bare(w): written(w, 0.05) for w in _WORDS["de"][1]})
        self.contexts = [c for line in CONTEXTS.split("\n") for c in line.replace("¶", "\n").split("|") if c] + ["{N} | {P} | {I}", "| {N} | {E} |"]
        self.mentions = MENTIONS.split("|")

    def syllables(self, ends: list[str]) -> str:
        r = self.r
        one = lambda: r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS)
        return "".join(one() for _ in range(r.choice([1, 2, 2, 3]))) if r.random() < 0.5 else "".join(one() for _ in range(r.choice([1, 1, 2]))) + r.choice(ends)

    def told(self, word: str, often: float) -> str:
        """A word of a name, which mail addresses may spell."""
        self.seen.held.clear()  # what is told changes
        if self.r.random() < 2 * often:
            self.seen.mail[bare(word)] = 2 if self.r.random() < 0.5 else 1
        if self.r.random() < 0.3 * often:
            self.seen.case[bare(word)] = 3 if self.r.random() < 0.8 else 2
        return word

    def family(self) -> str:
        r = self.r
        one = lambda: self.told(self.syllables(_END), 0.35).capitalize()
        x, k = one(), r.random()
        if k < 0.10:
            x = f"{x}-{one()}"
        elif k < 0.16:
            x = r.choice(["O'", "Mc", "Mac", "D'", "el-", "Al-"]) + x
        elif k < 0.28:
            x = r.choice(["von", "van", "de la", "dos", "de", "van der", "del", "di", "zu", "bin"]) + " " + x
        return x

    def first(self) -> str:
        r = self.r
        one = lambda: self.told(r.choice(self.given) if r.random() < 0.3 else self.syllables(_GIVEN_END), 0.4).capitalize()
        return f"{one()}-{one()}" if r.random() < 0.06 else one()

    def foreign(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.3:
            return "".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(r.choice([2, 3, 3, 4])))
        low, up = r.choice([("абвгдежзиклмнопрстуфхчшяюё", "АБВГДЕЖЗИКЛМНОПРСТУФХЧШЯ"), ("αβγδεζηικλμνοπρστυφχωάέίό", "ΑΒΓΔΕΖΗΙΚΛΜΝΟΠΡΣΤΦΧ")])
        word = lambda: r.choice(up) + "".join(r.choice(low) for _ in range(r.randint(3, 9)))
        return f"{word()} {word()}"

    def name(self) -> tuple[str, int, str]:
        """A name, how many characters of title stand before it, and the family name alone."""
        r, g, f = self.r, self.first(), self.family()
        i, k = r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ"), r.random()
        if k < 0.04:
            x = self.foreign()
            return x, 0, x.split()[-1]
        if k < 0.42:
            x = f"{g} {f}"
        elif k < 0.56:
            x = f"{f}, {g}"
        elif k < 0.62:
            x = f"{g} {i}. {f}"
        elif k < 0.69:
            x = f"{i}. {f}"
        elif k < 0.73:
            x = f"{f.upper()} {g}" if r.random() < 0.5 else f"{f.upper()}, {g}"
        elif k < 0.755:
            x = f"{g} {f}".upper()
        elif k < 0.80:
            x = f"{g} {f}".lower() if r.random() < 0.75 else f"{f} {g}"
        elif k < 0.83:
            x = f"{g} {self.first()} {f}"
        else:
            t = r.choice(["Mr. ", "Mr ", "Mrs. ", "Ms. ", "Ms ", "Dr. ", "Dr ", "Prof. ", "Sir ", "Herr ", "Frau ", "Herrn ", "M. ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Sr. ", "Sra. ", "Señor ", "Señora ", "Don ", "Doña ", "Herr Dr. ", "Frau Prof. ", "M. le Dr. "])
            return t + (f if r.random() < 0.7 else f"{g} {f}"), len(t), f
        return x, 0, f

    def mail(self) -> str:
        r = self.r
        g, f = (r.choice(self.given) if r.random() < 0.5 else self.syllables(_GIVEN_END)), self.syllables(_END)
        local = r.choice([f"{g}.{f}", f"{g}{r.randint(1, 99)}", f"{g[0]}{f}", f"{f}", f"{g}_{f}", f"{g}.{f}+{r.choice(['dev', 'work', 'news'])}", f"{r.choice('kuxz')}{r.randint(1000, 99999)}", f"{g}-{f}"])
        dom = [self.syllables([""]) + r.choice(["corp", "mail", "soft", "net", "-it", "box", "lab", ""]), r.choice(["example", "test", "invalid", "org", "com", "net", "edu", "co.uk", "example.net", "de", "fr", "es", "io"])]
        at, dot = r.choice([("@", ".")] * 9 + [("＠", "."), (" (at) ", "."), ("(at)", " dot "), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), ("@​", "."), (" @ ", "."), ("@ ", "."), ("&#64;", "."), ("%40", "."), ("\\u0040", "."), ("_at_", "."), ("_at_", " dot "), ("[at]", "(dot)"), (" {at} ", " dot ")])
        local, dom = bare(local), [bare(x) for x in dom]
        x = local + at + dot.join(dom).replace(".", dot)
        return x.upper() if r.random() < 0.07 and at == "@" else x.title() if r.random() < 0.07 and at == "@" else x

    def digits(self, shape: str) -> str:
        return re.sub("[#A%]", lambda m: str(self.r.randint(0, 9)) if m.group() == "#" else str(self.r.randint(1, 9)) if m.group() == "%" else self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ"), shape)

    def phone(self) -> str:
        """Numbers in national and international writing, half of them from ranges kept for fiction."""
        r = self.r
        s = r.choice(" -./ ")
        x = r.choice([
            f"%##{s}555{s}01##", "(%##) 555-01##", "+1 (%##) 555-01##", "+1%##55501##", "001 %## 555 01##", "+1-%##-555-01##", f"%##{s}%##{s}####", "(%##) %##-####", "(%##) 555 01##", "+1 %## %## ####",
            "+44 20 7946 0###", "020 7946 0###", "07700 900###", "+44 7700 900###", "+44 1## ### ####", "0## #### ####",
            "+33 6 39 98 ## ##", "+33 1 99 00 ## ##", "0033 6 39 98 ## ##", f"06{s}39{s}98{s}##{s}##", f"01{s}99{s}00{s}##{s}##", f"0%{s}##{s}##{s}##{s}##",
            "+49 (0)30 23125 ###", "030/23125-###", "030 23125 ###", "+49 171 39200##", "0%## ######", "0%##/#######", "+49 %## #######",
            "+34 6## ### ###", "+34 9## ## ## ##", "+39 0# #### ####", "+61-2-5550-####", "+81 %# #### ####", "+41 %# ### ## ##", "+55 %# 9####-####",
        ])
        x = self.digits(x)
        return x + (r.choice([" x", " ext. ", " ext ", " poste ", " Durchwahl "]) + str(r.randint(1, 999)) if r.random() < 0.08 else "")

    def number(self) -> str:
        """Numbers that states give to persons, some from ranges never given out."""
        s = self.r.choice("-- .– ")
        return self.digits(self.r.choice([f"%##{s}##{s}####", f"9##{s}##{s}####", f"000{s}##{s}####", "%########", "9########", "X#######A", "Y#######A", "Z#######A", f"########{self.r.choice(['', '-', ' '])}A", "##.###.###-A", "99.###.###A", "AA######A", "AA ## ## ## A", "QQ######B", "1 ## 0# ## ### ### ##", "2 ## 1# ## ### ### ##", "1 ## 20 99 ### ### ##", "2##0%##########"[:15], "%# ### ### ###", "00 ### ### ###", "%##########", "0##########", "00#########", "A########", "A0AAAA###", "A###AAAA#", "A#A####AA", "A#AAAAAAA", "A#######", "A#########"]))

    def address(self) -> str:
        r = self.r
        place = lambda ends: self.syllables(ends).capitalize()
        s, town, z = r.choice(_TITLED) if r.random() < 0.1 else place(_TOWN_END + ["wood", "field", "stone", "brook", "berg", "well", "", "", ""]), place(_TOWN_END), self.digits(r.choice(["#####", "00###", "#####", "####"]))
        n = str(r.randint(1, 320)) + r.choice(["", "", "", "", "a", "b", "c"])
        kind, unit = r.choice(["Street", "Road", "Lane", "Avenue", "Drive", "Court", "St", "St.", "Rd.", "Ave", "Way", "Close", "Terrace", "Crescent", "Boulevard", "Place", "Grove", "Gardens", "Row", "Hill", "Mews", "Square", "Green"]), r.choice(["Flat", "Apt", "Unit", "Suite"])
        x = r.choice([
            f"{n} {s} {kind}", f"{n} {s} {kind}", f"{n} {s} {kind}", f"{unit} {r.randint(1, 60)}, {n} {s} {kind}", f"{n} {s} {kind}, {unit} {r.randint(1, 60)}{r.choice(['', 'A', 'B'])}", f"{n} {r.choice(['N.', 'S.', 'North', 'West'])} {s} {kind}", f"{n} {s} {place(['', 'ton', 'wood'])}", f"{r.choice(['PO Box', 'P.O. Box', 'Postfach'])} {r.randint(10, 9999)}",
            f"{s}er Straße {n}", f"{s}str. {n}", f"{s}straße {n}", f"{s}strasse {n}", f"{s}{r.choice(['weg', 'gasse', 'allee', 'platz', 'ring', 'damm', 'ufer'])} {n}", f"{r.choice(['Am', 'An der', 'Im', 'Auf dem', 'Unter den', 'Zum'])} {s}{r.choice(['', '', 'er Ring', 'er Weg', 'er Allee'])} {n}",
            f"{n}, {r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse', 'allée', 'quai'])} {r.choice(['de ', 'des ', 'du ', 'de la ', ''])}{s}", f"{n} {r.choice(['bis ', 'ter ', '', '', ''])}{r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin'])} {r.choice(['de ', 'des ', 'du ', ''])}{s}", f"{n} bis, rue {r.choice(['de ', 'du ', ''])}{s}",
            f"{r.choice(['Calle', 'C/', 'Avda.', 'Avenida', 'Plaza', 'Paseo', 'Camino'])} {r.choice(['', '', 'de ', 'del '])}{s}{r.choice([' ', ', ', ' nº '])}{n}", f"{r.choice(['Avda.', 'Avenida', 'Calle', 'Plaza'])} {r.choice(['de ', 'del ', ''])}{s}, {n}", f"Calle {s} {n}, {r.randint(1, 9)}º {r.choice('ABCD')}", f"Via {s} {n}",
        ])
        x += r.choice(["", "", f", {town}", f", {z} {town}", f", {town} {z}", f", {town}, {self.digits('AA')} {z}"])
        if r.random() < 0.06:
            x = f"{n} {s} {kind}\n{unit} {r.randint(1, 20)}\n{town} {z}"
        elif r.random() < 0.12:
            x = x.replace(f", {z}", f"\n{z}")
        return x.lower() if r.random() < 0.06 else x

    def thing(self) -> str:
        return self.r.choice(_WORDS[self.r.choice(["en", "en", "fr", "es"])][1])

    def capital(self) -> str:
        r, k = self.r, self.r.random()
        return r.choice(_TITLED) if k < 0.55 else r.choice(_WORDS["de"][1]) if k < 0.8 else self.thing().capitalize() if k < 0.97 else self.syllables(["ware", "base", "hub", "kit", "ly", "soft"]).capitalize()

    def code(self) -> str:
        """A line of a program, a query, a log or a listing."""
        r, w, n = self.r, self.thing, lambda: r.randint(0, 3000)
        cap, low = lambda x: x[0].upper() + x[1:], lambda: f"{w()}_{w()}"
        return r.choice([
            lambda: r.choice([str.upper, str.lower])(f"select {w()}, count(*) from {w()}s where {w()} {r.choice(['>', '=', '<='])} ") + f"{n()} " + r.choice(["GROUP BY 1", "ORDER BY 2 DESC", f"GROUP BY {w()}", "LIMIT 10", f"AND {w()} IS NULL"]) + r.choice(["", ";"]),
            lambda: f"{r.choice(['INSERT INTO', 'DELETE FROM', 'CREATE TABLE', 'ALTER TABLE', 'DROP INDEX'])} {low()} {r.choice(['VALUES', 'WHERE', 'ADD COLUMN', '(', 'SET'])} {w()}",
            lambda: f"{n():02d}"[:2] + f":{r.randint(10, 59)}:{r.randint(10, 59)} {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} [{w()}] {w()} {n()} {r.choice(['ok', 'ms', 'retry', 'Failed', 'Connection Reset'])}",
            lambda: f"{r.choice(['fn', 'def', 'func', 'function'])} {low()}({w()}: {r.choice(['&str', 'int', 'String', 'Option<u8>'])}) -> {cap(w())}{cap(w())}",
            lambda: f"{r.choice(['let', 'const', 'var', 'return', 'for', 'if', 'raise', 'throw new'])} {cap(w())}{r.choice(['Error', 'Type', 'Id', ''])}({low()}, {n()})",
            lambda: f"{r.choice(['RFC', 'ISO', 'IEEE', 'PEP', 'CVE', 'Section', 'Chapter', 'Table', 'Figure', 'Fig.', 'Python', 'Java', 'Version', 'Zeile', 'Seite', 'Kapitel', 'Absatz', 'Abschnitt', 'Anhang', 'Ligne', 'Chapitre', 'Annexe', 'Página', 'Capítulo', 'Apartado'])} {n()}{r.choice(['', f' {w()} {n()}', f'.{r.randint(0, 9)}', f', {self.capital()}'])}",
            lambda: f"{r.choice(['version', 'v', 'release', 'tag', 'build'])} {self.near_miss('v')} {r.choice(['is newer than', 'was replaced by', '->', 'and', 'before'])} {self.near_miss('v')}",
            lambda: f"{n()} {r.choice(['files', 'Files', 'tests', 'Tests', 'Dateien', 'Zeilen', 'Sekunden', 'fichiers', 'archivos', 'MB', 'ms', 'KB', 'rows'])} {r.choice(['changed', 'passed', 'fehlen', 'offen', 'modifiés', 'left', 'total'])}, {n()} {r.choice(['failed', 'Fehler', 'lignes', 'lines', 'MB'])}",
            lambda: f"{self.capital()} {self.capital()} {r.choice(['and', 'or', 'und', 'et', 'y', '&'])} {self.capital()} {self.capital()} {r.choice(['differ', 'merged', 'fehlen', 'restent', 'fallan', ''])}",
            lambda: f"{r.choice(['GET', 'POST', 'PUT', 'HEAD'])} /{w()}/{n()} HTTP/1.1 {r.randint(100, 599)} {r.choice(['OK', 'Not Found', 'Bad Request', 'No Content'])}",
            lambda: f"{r.choice(['the', 'a', 'this', 'der', 'le', 'el', 'no', 'each'])} {r.choice(['HTTP', 'API', 'JSON', 'SQL', 'CPU', 'TLS', 'CI', 'URL', 'UTF'])} {r.choice([self.capital, w])()} {r.choice(['', n()])}",
        ])()

    def filling(self) -> str:
        """A sentence of no one: words of one language with codes, numbers and capitals among them."""
        r = self.r
        if r.random() < 0.3:
            return self.code()
        small, nouns, verbs = _WORDS[r.choice(list(_WORDS))]
        out = []
        for _ in range(r.randint(1, 3)):
            out += [r.choice(small), r.choice(nouns)] + ([r.choice(verbs)] if r.random() < 0.7 else []) + ([r.choice([lambda: str(r.randint(0, 4000)), lambda: f"{r.randint(2, 900)} {r.choice(nouns)}", self.odd, self.capital, lambda: f"{r.choice(_TITLED)} {r.choice(_TITLED)}" if r.random() < 0.4 else r.choice(nouns), lambda: f"{r.choice(nouns)}_{r.choice(nouns)}()", lambda: f"{r.choice(nouns)}/{r.choice(nouns)}.{r.choice(['py', 'rs', 'ts'])}"])()] if r.random() < 0.4 else [])
        text = " ".join(out)
        if r.random() < 0.6:
            text = r.choice([f"{text[0].upper()}{text[1:]}", f"{r.choice(_TITLED)} {text}", f"{r.choice(_TITLED)}: {text}", f"{r.choice(_TITLED)} {r.choice(_TITLED)} {text}", f"{r.choice(_TITLED)}: {self.capital()} {text}", f"# {self.capital()} {self.capital()}", f"{self.capital()}, {self.capital()} {text}"])
        return text + r.choice(["", ".", ".", "?", "!", ":"])

    def odd(self) -> str:
        return self.near_miss(self.r.choice("spblchvn"))

    def near_miss(self, k: str) -> str:
        r, d = self.r, self.digits
        host = lambda: f"{r.choice(['node', 'edge', 'web', 'db', 'runner', 'build'])}{r.choice(['', '-'])}{r.randint(1, 40)}" + r.choice(["", ".internal", f".{self.syllables(['corp', 'net'])}.{r.choice(['test', 'example', 'com'])}"])
        return {
            "k": lambda: r.choice(_BEGIN), "u": lambda: self.syllables(_END).capitalize() if r.random() < 0.4 else r.choice(_TITLED), "f": lambda: " ".join(r.choice([r.choice(x[0]), r.choice(x[1]), r.choice(x[2])]) for x in [_WORDS[r.choice(list(_WORDS))]] for _ in range(r.randint(1, 4))),
            "s": lambda: d("###-##-####"), "p": lambda: d(r.choice(["### ### ####", "###-###-####", "(###) ###-####"])), "b": lambda: d(r.choice(["20######.###.####", "##.#.####", "20##.##.##", "#.##.###.####"])), "l": lambda: d(r.choice(["1#########", "#######", "##########", "0#########", "1############", "########", "###########", "#########"])),
            "c": lambda: d(r.choice(["A########", "AAA-####", "A#######A", "AA-##", "AA######", "A#AA##"])), "h": lambda: "".join(r.choice("0123456789abcdef"[: r.choice([10, 16, 16])]) for _ in range(r.choice([6, 7, 7, 8, 10, 12]))), "z": lambda: d(r.choice(["00#-###-####", "###-####", "0-######"])), "v": lambda: ".".join(d("#" * r.choice([1, 1, 2, 2, 3, 4, 5])) for _ in range(r.choice([2, 3, 3, 4]))),
            "g": lambda: f"git@{self.thing()}.{self.syllables(['hub', 'lab', 'forge'])}.{r.choice(['com', 'example', 'test'])}:{self.thing()}/{self.thing()}.git", "m": lambda: f"{r.choice(sorted(MACHINE))}@{host()}", "w": self.thing, "W": self.capital, "n": lambda: str(r.randint(1, 2000)), "d": lambda: r.choice(["Monday", "May", "2024", d("%.%.19##"), d("19##-0%-1#")]),
            "t": lambda: r.choice([".", ".", "", ",", " today.", "!"]), "o": lambda: r.choice(["", " uptime", ": refused", ":/tmp/x ."]),
        }[k]()

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text of contexts and filling, and its items as (start, end, first label)."""
        r, out, items = self.r, "", []
        names: list = []
        todo = [r.choice(self.contexts) if r.random() < 0.5 else None for _ in range(r.randint(1, 6))]
        while todo:
            c = todo.pop(0)
            if c and "{N}" in c and r.random() < 0.3:
                at = r.randint(0, len(todo))
                todo[at:at] = [r.choice(self.mentions) for _ in range(r.randint(1, 3))] + ([None] if r.random() < 0.5 else [])
            if out:
                out += r.choice([" ", " ", " ", "\n"])
            if c is None:
                out += self.filling()
                continue
            c = _CHOICE.sub(lambda m: r.choice(m.group(1).split("/")), c)
            at = 0
            c = c.replace("{{", "\x00").replace("}}", "\x01")
            for m in _ITEM.finditer(c):
                out += c[at : m.start()]
                at, k = m.end(), m.group(1)
                if k == "N":
                    x, skip, family = r.choice(names) if names and r.random() < 0.3 else self.name()
                    names.append((x, skip, family))
                    items.append((len(out) + skip, len(out) + len(x), 6))
                elif k == "M":
                    x = names[-1][2] if names else self.family()
                    items.append((len(out), len(out) + len(x), 6))
                elif k in "EPIA":
                    x = {"E": self.mail, "P": self.phone, "I": self.number, "A": self.address}[k]()
                    items.append((len(out), len(out) + len(x), {"E": 1, "P": 2, "I": 3, "A": 4}[k]))
                else:
                    x = self.near_miss(k)
                out += x
            out += c[at:]
        return out.replace("\x00", "{").replace("\x01", "}"), items


def gold(toks, where, items) -> list[int]:
    y = []
    for i in where:
        s, e, k, _ = toks[i]
        lab = 0
        for a, b, first in items:
            if s < b and e > a:
                if first in (4, 6):
                    began = any(toks[j][0] < b and toks[j][1] > a for j in range(max(0, i - 1), i))
                    lab = first + (1 if began else 0)
                else:
                    lab = first
                break
        y.append(lab)
    return y


#: By how much (log-odds) a token's being no item must be likelier than each other reading.
LEAN = 0.25


class Field:
    """The fitted field: unary weights by feature and the potentials of edges."""

    def __init__(self, ids: dict[str, int], w, trans, start, end, skip):
        self.ids, self.w, self.trans, self.start, self.end, self.skip = ids, w, trans, start, end, skip
        self.seen = Evidence()

    def knowing(self, seen: Evidence) -> Field:
        """The same field with what all texts say of words."""
        out = Field(self.ids, self.w, self.trans, self.start, self.end, self.skip)
        out.seen = seen
        return out

    def found(self, texts: list[str], alone: bool = True) -> list[list[tuple[int, int, str]]]:
        """Items of each text as (start, end, type); without alone, no names of one word without a title."""
        flat, allowed, chains, skips, kept = [], [], [], [], []
        base, ids = 0, self.ids
        number = lambda x: ids.get(x, 0)
        for t in texts:
            toks, where, feats = analyse(t, self.seen, number) if t else ([], [], [])
            kept.append((toks, where, base))
            flat += feats
            allowed += [_PENALTY[toks[i][2]] for i in where]
            chains += [(a + base, b + base) for a, b in _chains(where)]
            skips += [(a + base, b + base) for a, b in _skips(toks, where)]
            base += len(where)
        if not base:
            return [[] for _ in texts]
        sizes = np.fromiter((len(f) for f in flat), np.int64, base)
        ids = np.fromiter((x for f in flat for x in f), np.int64, sizes.sum())
        unary = np.add.reduceat(self.w[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]])) + np.stack(allowed)
        belief = infer(unary, chains, np.array(skips, np.int64).reshape(-1, 2), self.trans, self.start, self.end, self.skip)
        belief[:, 0] -= LEAN  # to miss an item is worse than to replace a word too many
        best = belief.argmax(1)
        out = []
        for toks, where, b in kept:
            items, open_ = [], None
            for j, i in enumerate(where):
                s, e, k, _ = toks[i]
                y = int(best[b + j])
                kind = _KIND[y]
                if open_ and (kind != open_[2] or y in (0, 1, 2, 3, 4, 6) or i != open_[3] + 1):
                    items.append(open_)
                    open_ = None
                if kind:
                    open_ = [open_[0] if open_ else s, e, kind, i, (open_[4] if open_ else []) + [i]]
            if open_:
                items.append(open_)
            out.append([x for x in (self.tidy(it, toks) for it in items) if x])
        return out if alone else [whole(items, t) for items, t in zip(out, texts)]

    @staticmethod
    def tidy(item, toks):
        """Outer marks and titles don't belong to an item; a name without a word and an address without a word of three letters and a number are none,
        nor is one word beside a number that does not read as a street."""
        s, e, kind, _, own = item
        if kind in ("name", "address"):
            while own and (toks[own[0]][2] == "SIGN" or (kind == "name" and len(own) > 1 and flag(*toks[own[0]][2:]) == "title")):
                own = own[1:]
            while own and toks[own[-1]][2] == "SIGN":
                own = own[:-1]
            if kind == "name" and own and bare(toks[own[0]][3]) in ("la", "los", "der", "den") and own[0] and bare(toks[own[0] - 1][3]) in ("de", "van", "von"):
                own = [own[0] - 1, *own]  # a particle of two words
            if not own or (kind == "name" and not any(toks[i][2] == "WORD" and len(toks[i][3]) > 1 for i in own)):
                return None
            if kind == "address" and not (any(toks[i][2] == "WORD" and len(toks[i][3]) > 2 for i in own) and any(toks[i][2] == "NUM" for i in own)):
                return None
            if kind == "address" and sum(toks[i][2] == "WORD" for i in own) < 2 and not any(flag(*toks[i][2:]).removeprefix("low") in ("street", "streetend", "unit") for i in own):
                return None
            s, e = toks[own[0]][0], toks[own[-1]][1]
        return s, e, kind


@cache
def fit(texts: int = 20000, epochs: int = 5, seed: int = 11, least: int = 4) -> Field:
    """Pseudo-likelihood: each label given its neighbours' and its repetitions' gold labels, by Adagrad.

    Features of fewer than `least` tokens have no weight, so no name is learned by heart. The field depends on the
    parameters alone and is fitted once a process.
    """
    writer, numbers = Writer(seed), Numbers()
    ids, sizes, ys, left, right, skip_of, base = [], [], [], [], [], [], 0
    for _ in range(texts):
        t, items = writer.text()
        toks, where, feats = analyse(t, writer.seen if writer.r.random() < 0.6 else Evidence(), numbers.__getitem__)  # there may be none
        y = gold(toks, where, items)
        for a, b in _chains(where):
            for j in range(a, b):
                left.append(y[j - 1] if j > a else _Y)
                right.append(y[j + 1] if j < b - 1 else _Y)
        skip_of += [(a + base, b + base) for a, b in _skips(toks, where)]
        ys += y
        sizes += [len(f) for f in feats]
        ids += [x for f in feats for x in f]
        base += len(y)
    ids, sizes, ys, left, right = np.array(ids), np.array(sizes), np.array(ys), np.array(left), np.array(right)
    off = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    often = np.bincount(ids, minlength=len(numbers) + 1) >= least
    often[0] = False
    renamed = np.where(often, np.cumsum(often), 0)
    ids = renamed[ids]
    known = {x: int(renamed[k]) for x, k in numbers.items() if often[k]}
    other = np.full(base, _Y)
    for a, b in skip_of:
        other[a], other[b] = ys[b], ys[a]
    w, tr, sk = np.zeros((len(known) + 1, _Y)), np.zeros((_Y + 1, _Y + 1)), np.zeros((_Y, _Y))
    gw, gt, gs = np.full_like(w, 1e-6), np.full_like(tr, 1e-2), np.full_like(sk, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(base), max(1, base // 1024)):
            n = sizes[rows]
            o = np.concatenate([[0], np.cumsum(n)[:-1]])
            f = ids[np.arange(n.sum()) - np.repeat(o, n) + np.repeat(off[rows], n)]
            z = np.add.reduceat(w[f], o)
            near = (rng.random((len(rows), 1)) < 0.7).astype(float)  # as must a token without its neighbours' labels
            z = z + near * (tr[left[rows], :_Y] + tr[:_Y, right[rows]].T)
            has = (other[rows] < _Y) & (rng.random(len(rows)) < 0.4)  # a mention must be plain by itself too
            z[has] += sk[:, other[rows][has]].T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), ys[rows]] -= 1
            u, inv = np.unique(f, return_inverse=True)
            g = np.zeros((len(u), _Y))
            big = np.repeat(p, n, 0)
            for y in range(_Y):
                g[:, y] = np.bincount(inv, big[:, y], minlength=len(u))
            gw[u] += g * g
            g[u == 0] = 0.0
            w[u] -= 0.15 * g / np.sqrt(gw[u]) + 2e-6 * len(rows) * w[u]
            dt = np.zeros_like(tr)
            np.add.at(dt[:, :_Y], left[rows], p * near)
            np.add.at(dt.T[:, :_Y], right[rows], p * near)
            gt += dt * dt
            tr -= 0.1 * dt / np.sqrt(gt)
            if has.any():
                ds = np.zeros_like(sk)
                np.add.at(ds.T, other[rows][has], p[has])
                ds = ds + ds.T
                gs += ds * ds
                sk -= 0.05 * ds / np.sqrt(gs)
    return Field(known, w.astype(np.float32), tr[:_Y, :_Y], tr[_Y, :_Y], tr[:_Y, _Y], sk)


def whole(items: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
    """Without the names that are a family or given name alone: of one word, with no title before it."""
    out = []
    for s, e, kind in items:
        words = _NAME_WORD.findall(text[s:e])
        if kind != "name" or len(words) > 1 or _WIDE.match(text[s]) and e - s > 1:
            out.append((s, e, kind))
        else:
            before = _LAST_WORD.search(text[max(0, s - 40) : s])
            if before and flag("WORD", before.group(1)) == "title":
                out.append((s, e, kind))
    return out


_NAME_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*+)+(?:['’\-][^\W\d_]+)*")
_LAST_WORD = re.compile(r"((?:[^\W\d_][\u0300-\u036f]*+)+)\.?\s+$")


def found(df: DataFrame, keys: list[str], text: str, field: Field | None = None, alone: bool = True) -> DataFrame:
    """One row per item: keys, pii_type, start_pos, end_pos (code points, end excluded), item.

    Without alone, a family or given name that stands alone is no item. Null and empty texts have none; whole texts are searched; repeated rows give repeated items.
    """
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((field or fit()).knowing(evidence(df, text)))  # size fixed by the number of hashed features

    @F.pandas_udf("array<struct<start_pos:bigint,end_pos:bigint,pii_type:string>>")
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf = sent.value
        for b in batches:
            texts, out = list(b), []
            for i in range(0, len(texts), 2000):
                out += [[{"start_pos": s, "end_pos": e, "pii_type": k} for s, e, k in x] for x in crf.found(texts[i : i + 2000], alone)]
            yield pd.Series(out, index=b.index)

    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_t"))
    rows = spread(rows).select("*", F.explode(items("_t")).alias("_i"))
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_i.pii_type", "_i.start_pos", "_i.end_pos", F.expr("substring(_t, cast(_i.start_pos as int) + 1, cast(_i.end_pos - _i.start_pos as int))").alias("item"))


def redact(text: str, items) -> str:
    """The text with each item replaced by [TYPE] and nothing else changed."""
    out, at = [], 0
    for s, e, k in sorted(items):
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text: str, into: str = "redacted", field: Field | None = None) -> DataFrame:
    """df with the text redacted; null stays null."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((field or fit()).knowing(evidence(df, text)))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from skein.llm.pii import redact

        for b in batches:
            texts, out = list(b), []
            for i in range(0, len(texts), 2000):
                got = sent.value.found(texts[i : i + 2000])
                out += [redact(t, x) if t else t for t, x in zip(texts[i : i + 2000], got)]
            yield pd.Series(out, index=b.index)

    return spread(df).withColumn(into, clean(F.col(text)))
