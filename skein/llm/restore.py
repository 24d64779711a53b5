"""Noisy-channel restoration of disguised words.

A disguised token becomes a lattice: every observed character can stand for the letters it resembles,
a mask for any letter, repetitions for nothing, separators for nothing or a word edge, two letters for
each other. Viterbi finds the most likely letters under a character language model: a mixture of 4-grams
counted over all documents and a word list. No state is dropped: where many letters are possible the
states are an array over the last three letters, else a table. A word of letters only is read as itself
or as a listed word it can stand for, as doubled letters and neighbours exchanged are ordinary spelling.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import ship

#: Letters of the language model; 0 is the edge of a word.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz'"
_N = len(ALPHABET)
_CODE = {c: i for i, c in enumerate(ALPHABET)}
# What a character can stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "&": "a"}
MASKS = "*#%?•"
SEPARATORS = ".-_ ~·,'"
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухкмтнвіјѕԁӏԛԝгпзьбαβεικνορτυχωϲɡıℓɑо", "aeopcyxkmthbijsdlqwrn3b6abeikvoptuxwcgilao"))
_TABLE = str.maketrans(LOOKALIKES)
_HIDDEN = re.compile("[​-‏⁠﻿­͏᠎]")
_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿]")


def plain(text: str) -> str:
    """Lower case without accents, hidden characters, look-alikes and wrongly decoded UTF-8."""
    if text.isascii():
        return text.lower()
    if _MOJIBAKE.search(text):
        text = _MOJIBAKE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_TABLE)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ß", "ss")
    return text.replace("’", "'").replace("œ", "oe").replace("æ", "ae").replace("ø", "o")


def count_ngrams(texts) -> np.ndarray:
    """4-gram counts of the words of plain texts over ALPHABET, dense."""
    out = np.zeros(_N**4, np.int64)
    look = np.zeros(256, np.int64)
    for c, i in _CODE.items():
        look[ord(c)] = i
    block: list[bytes] = []

    def flush():
        if block:
            x = look[np.frombuffer(b"^^^".join(block) + b"^^^", np.uint8)]
            codes = ((x[:-3] * _N + x[1:-2]) * _N + x[2:-1]) * _N + x[3:]
            np.add(out, np.bincount(codes, minlength=_N**4), out=out)
            block.clear()

    size = 0
    for t in texts:
        words = "^^^".join(re.findall(r"(?<![\w/.:])[a-z']+(?![\w/:(])", plain(t)))
        block.append(b"^^^" + words.encode())
        size += len(words)
        if size > 4_000_000:
            flush()
            size = 0
    flush()
    return out


def language_model(docs: DataFrame, text: str) -> np.ndarray:
    """Log probabilities of the 4-grams of all documents: a dense array whose size is fixed by the alphabet."""
    ship(docs.sparkSession)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from skein.llm.restore import count_ngrams

        got = count_ngrams(t for b in batches for t in b["t"] if t)
        at = np.flatnonzero(got)
        yield pd.DataFrame({"code": at, "n": got[at]})

    counts = np.zeros(_N**4)
    rows = docs.select(F.col(text).alias("t")).mapInPandas(part, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most 28^4 rows
    counts[rows["code"].to_numpy(np.int64)] = rows["n"]
    return log_probabilities(counts)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Interpolated 4-, 3- and 2-gram log probabilities, shape (28, 28, 28, 28)."""
    c4 = counts.reshape(_N, _N, _N, _N).astype(float)
    c3, c2 = c4.sum(0), c4.sum((0, 1))
    p2 = (c2 + 0.1) / (c2 + 0.1).sum(-1, keepdims=True)
    p3 = (c3 + 2 * p2[None]) / (c3.sum(-1, keepdims=True) + 2)
    return np.log((c4 + 2 * p3[None]) / (c4.sum(-1, keepdims=True) + 2)).astype(np.float32)


_COST = {"same": 0.0, "leet": -0.7, "digit": -2.5, "mask": -0.5, "gap": -0.3, "edge": -1.35, "repeat": -0.4, "swap": -2.0, "doubt": -4.0}


#: Readings at a place from which the states are kept in an array.
_DENSE = 20


class Restorer:
    """Decodes disguised tokens with a language model and a word list; keeps what it has decoded."""

    def __init__(self, model: np.ndarray, words: list[str]):
        self.model = model
        self.memo: dict[str, str] = {}
        self.words = sorted({plain(w) for w in words if " " not in w})
        self.known = set(self.words)
        self.trie: dict = {}
        for w in self.words:
            at = self.trie
            for c in w:
                at = at.setdefault(c, {})
            at["$"] = w

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Per position the letters it can stand for ('' for none, ' ' for a word edge) with their log channel probability."""
        out = []
        for i, c in enumerate(token):
            inner = 0 < i < len(token) - 1
            if c.isalpha():
                alts = [(c, _COST["same"])]
                if i and token[i - 1] == c:
                    alts.append(("", _COST["repeat"] if i > 1 and token[i - 2] == c else _COST["repeat"] * 4))
            elif c in MASKS:
                alts = [(x, _COST["mask"]) for x in ALPHABET[1:-1]]
            elif c in LEET:
                alts = [(x, _COST["leet"]) for x in LEET[c]]
                if not c.isdigit():
                    alts.append(("", _COST["digit"]))
            elif c in SEPARATORS and inner:
                alts = [("", _COST["gap"]), (" ", _COST["edge"])]
            else:
                alts = [("", _COST["digit"])]
            out.append(alts)
        return out

    def listed(self, lattice, swaps: bool = False) -> tuple[float, str]:
        """The likeliest listed word (of one word) that a lattice can stand for, by Viterbi over the trie of the list."""
        here: list[dict] = [{} for _ in range(len(lattice) + 2)]
        here[0][id(self.trie)] = (0.0, self.trie, "")

        def reach(at: int, score: float, node: dict, word: str) -> None:
            old = here[at].get(id(node))
            if old is None or old[0] < score:
                here[at][id(node)] = (score, node, word)

        for i, alts in enumerate(lattice):
            for score, node, word in here[i].values():
                for x, cost in alts:
                    to = node if x == "" else node.get(x) if x != " " else None
                    if to is not None:
                        reach(i + 1, score + cost, to, word + x)
                if swaps and 0 < i < len(lattice) - 2:  # neither the first nor the last letter moves
                    a, b = lattice[i][0][0], lattice[i + 1][0][0]
                    to = node.get(b, {}).get(a) if a != b and a.isalpha() and b.isalpha() else None
                    if to is not None:
                        reach(i + 2, score + _COST["swap"], to, word + b + a)
        done = [(score - np.log(len(self.words)), word) for score, node, word in here[len(lattice)].values() if "$" in node]
        return max(done, default=(-1e9, ""))

    def decode(self, lattice, free: bool = True, listed: bool = False) -> tuple[float, str]:
        """Viterbi path under the 4-grams (free), the word list (listed) or, word by word, the likelier of both.

        States are the last three letters of a free word and the trie node of a listed one; a word edge ends the
        best word of either kind and begins both anew.
        """
        n = len(lattice)
        edges = [i for i, alts in enumerate(lattice) if any(x == " " for x, _ in alts)]
        # best reading of each piece between two places where a word can begin and end, joined by the best edges
        begins, ends = [0, *(i + 1 for i in edges)], [*edges, n]
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}
        final = (-1e9, "")
        for a in begins:
            if a not in best:
                continue
            wanted = [e for e in ends if e > a]
            pieces = self._words(lattice, a, wanted, free, listed)
            for e in wanted:
                score, word = pieces.get(e, (-1e9, ""))
                if not word:
                    continue
                total, text = best[a][0] + score, best[a][1] + word
                if e == n:
                    final = max(final, (total, text))
                else:
                    cost = next(c for x, c in lattice[e] if x == " ")
                    if e + 1 not in best or best[e + 1][0] < total + cost:
                        best[e + 1] = (total + cost, text + " ")
        return final

    def _words(self, lattice, a: int, wanted: list[int], free: bool, listed: bool) -> dict[int, tuple[float, str]]:
        """The best single word from place a to each wanted place."""
        out: dict[int, tuple[float, str]] = {}
        last = wanted[-1]
        if listed:
            nodes = {id(self.trie): (0.0, self.trie, "")}
            for i in range(a, last + 1):
                if i in wanted:
                    done = [(s - np.log(len(self.words)), w) for s, node, w in nodes.values() if "$" in node]
                    if done:
                        out[i] = max(done)
                if i == last or not nodes:
                    break
                near: dict = {}
                for s, node, w in nodes.values():
                    for x, cost in lattice[i]:
                        to = node if x == "" else node.get(x) if x != " " else None
                        if to is not None and (id(to) not in near or near[id(to)][0] < s + cost):
                            near[id(to)] = (s + cost, to, w + x)
                nodes = near
        if free:
            for e, got in self._free(lattice, a, wanted).items():
                out[e] = max(out.get(e, (-1e9, "")), got)
        return out

    def _free(self, lattice, a: int, wanted: list[int]) -> dict[int, tuple[float, str]]:
        """The best free word from place a to each wanted place: exact, in a table or an array of all states."""
        out: dict[int, tuple[float, str]] = {}
        last, model = wanted[-1], self.model
        states: dict = {(0, 0, 0): (0.0, "")}
        dense = None  # scores over the last three letters, and behind it the choices that led there
        for i in range(a, last + 1):
            if i in wanted:
                if dense is None:
                    out[i] = max(((s + float(model[k][0]), w) for k, (s, w) in states.items()), default=(-1e9, ""))
                else:
                    scores = dense[0] + model[:, :, :, 0]
                    at = int(scores.argmax())
                    out[i] = (float(scores.ravel()[at]), self._trace(dense[1], at))
            if i == last:
                break
            alts = [(x, c) for x, c in lattice[i] if x != " "]
            if dense is None and len(alts) >= _DENSE:
                dense = (np.full((_N, _N, _N), -1e9, np.float32), [dict(states)])
                for k, (s, _) in states.items():
                    dense[0][k] = s
            if dense is None:
                nxt: dict = {}
                for (p, q, r), (score, word) in states.items():
                    row = model[p, q, r]
                    for x, cost in alts:
                        if x == "":
                            key, s, w = (p, q, r), score + cost, word
                        else:
                            k = _CODE.get(x, 0)
                            key, s, w = (q, r, k), score + cost + float(row[k]), word + x
                        if key not in nxt or nxt[key][0] < s:
                            nxt[key] = (s, w)
                states = nxt
            else:
                now = np.full((_N, _N, _N), -1e9, np.float32)
                from_ = np.full((_N, _N, _N), -1, np.int8)  # the letter before the last three; -1 where nothing was added
                for x, cost in alts:
                    if x == "":
                        stay = dense[0] + cost
                        better = stay > now
                        now[better], from_[better] = stay[better], -1
                    else:
                        k = _CODE.get(x, 0)
                        add = dense[0] + model[:, :, :, k] + cost
                        top, who = add.max(0), add.argmax(0)
                        better = top > now[:, :, k]
                        now[:, :, k][better], from_[:, :, k][better] = top[better], who[better]
                dense = (now, [*dense[1], from_])
        return out

    @staticmethod
    def _trace(behind: list, at: int) -> str:
        """The letters of the path that ends in a state."""
        key = (at // (_N * _N), at // _N % _N, at % _N)
        word = ""
        for from_ in reversed(behind[1:]):
            before = int(from_[key])
            if before >= 0:
                word = ALPHABET[key[2]] + word
                key = (before, key[0], key[1])
        return behind[0].get(key, (0.0, ""))[1] + word

    def letters(self, t: str) -> str:
        """A word of letters: itself, or the listed word it can stand for by letters doubled or exchanged, if that is likelier.

        Both are ordinary spelling, so a disguise is doubted at first; words common in the documents ('bitte')
        stay, and so do words that are none of the list either way ('harness').
        """
        score, word = self.listed(self.lattice(t), swaps=len(t) >= 5)
        return word if word and score + _COST["doubt"] > self.decode([[(c, _COST["same"])] for c in t])[0] else t

    def token(self, t: str) -> str:
        got = self.memo.get(t)
        if got is None:
            if t in self.known:
                got = t
            elif t.isalpha() and not _TRIPLE.search(t):
                got = self.letters(t)
            elif _HEX.match(t):
                got = t
            else:
                got = self.decode(self.lattice(t), listed=True)[1] or t
            if len(self.memo) < 200_000:
                self.memo[t] = got
        return got

    def text(self, text: str) -> str:
        """The plain text with every disguised token restored."""
        return _UNIT.sub(lambda m: self.token(m.group()), plain(text))


_HEX = re.compile(r"(?=(?:[a-f]*[0-9]){2})[0-9a-f]{5,}$")
_TRIPLE = re.compile(r"(.)\1\1")
_L = "[a-z]"
_SIGNS = re.escape("".join(sorted({*LEET, *MASKS} - set("0123456789?!+&|"))))
_SEPARATED = re.escape(SEPARATORS.replace(" ", "") + "*")
# A disguised token: letters set apart by separators, or letters mixed with signs, masks and separators that stand alone between
# letters; words with three of a letter or four letters and more, which may have letters exchanged or doubled. Marks at the end
# of a sentence end a token. Paths, calls, addresses and numbers are left alone.
_UNIT = re.compile(
    r"(?<![\w/.:@<`\-])(?:"
    + rf"{_L}(?:[{_SEPARATED}]{_L}(?![a-z0-9])){{2,}}+(?![/(@=]|:\w)"
    + rf"|{_L}(?: {_L}(?![\w'])){{2,}}+(?![/(@=*]|[:.]\w)"
    + rf"|(?=[^\sa-z]*+[a-z])(?=[a-z]*+[0-9!|+?&{_SIGNS}])[a-z0-9{_SIGNS}]++(?:[!|+?&]++[a-z0-9{_SIGNS}]++)*+(?<!\()(?![\w/(:@=.\-]\w)"
    + r"|[a-z]{4,}+(?![\w/(:@=])"
    + r"|[a-z]*?([a-z])\1\1[a-z]*+(?![\w/(:@=])"
    + r")"
)
