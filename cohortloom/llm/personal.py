"""Personal data: four base patterns, and a linear-chain conditional random field over word shapes.

The field labels the tokens of a line with B-, I- and O labels of KINDS. A token's features are its shape and,
for cue words, its lower-case form, and those of its neighbours (OFFSETS). It is trained on the small labelled
table below, by gradient steps on the exact log likelihood (forward and backward sums over padded lines).

Decoding works on pieces of many lines. Each different token gets one row of scores for each offset, so a token's
emissions are a few gathered rows. A stretch of tokens can only leave O if its gains over O add up to more than
nothing at the best transitions; prefix sums give, for all tokens at once, the greatest such sum of any stretch
around them. Elsewhere O is proven; what is left is decoded by Viterbi in batches, exactly as the whole
line would be. Spans of the field that overlap a base span are dropped; base spans stay.

Work is within the row: no shuffle, and a lost task repeats its rows only. Lines are independent, and no pattern
crosses a line end, so long texts are handled in chunks of whole lines.

Defined cases: a null text counts as empty: no spans. Equal scores go to O, then to the label listed first.
Repeated rows have the same spans. A line of any length is decoded whole. An empty table gives an empty table.
Other columns are kept; the result is one struct column, named by the caller.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- base patterns of the contract -------------------------------------------------------------------

BASE_KINDS = ("email", "ip", "card", "phone")  # fixed order
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that began inside a run of digits would end like the one that begins with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = str.maketrans("", "", " ()+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @ behind the run of local characters, so matches are found from there."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            free = m.end()
            yield start, free
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].translate(_NO_DIGITS)) <= 19 and luhn(d):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(m[0].translate(_NO_DIGITS)) <= 15]
    return sorted(spans, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


# --- labelled table ------------------------------------------------------------------------------------

KINDS = ("person", "street", "birth", "number")
LABELS = ("O", *(f"{side}-{kind}" for kind in KINDS for side in "BI"))

PERSONS = """Anna Keller|John Hartley|Maria Lopez Vega|Luc Moreau|Sofia Brandt|Peter O'Neil|Claire Dubois|Jürgen Weiß|Elena Garcia|Tom Baxter
Ruth Adler|Karim Haddad|Inés Duarte|Paul-Henri Petit|Greta Lindholm|Samuel Okoro|Nadia Rahman|Victor Hugo Pires|Lena Vogt|Owen Price""".replace("\n", "|").split("|")
STREETS = """12 Oak Street|4 Mill Lane|221 Baker Street|77 Station Road|9 Rue des Fleurs|Hauptstraße 15|Calle Mayor 8|Gartenweg 3|1600 Park Avenue|35 Avenue Victor Hugo
Lindenstraße 102|Calle Nueva 21|18 Rue de Lyon|6 Garden Road|Am Weg 7|40 Hill Avenue|Calle del Sol 5|Bergstraße 9|14 Rue Haute|88 Long Lane""".replace("\n", "|").split("|")
BIRTHS = """12.03.1984|04/11/1975|1990-06-21|3 May 1968|17. Juli 1959|8 mars 1972|25 de abril de 1981|30-09-1963|1 January 2001|02.12.1947
21/08/1999|1955-01-30|9. Mai 1988|14 juillet 1993|6 de mayo de 1970|19 June 1979|28.02.1996|07/07/1961|11 October 1950|1983-12-05""".replace("\n", "|").split("|")
NUMBERS = """X4819027|C01X00T47|078-05-1120|DE89370400440532013000|L8923456|536-22-8790|PA0940443|GB29NWBK60161331926819|AB1234567|09FL21876
219-09-9999|K7710034|ES9121000418450200051332|T22000129|M3345781|457-55-5462|FR1420041010050500013M02606|P4366918|YA8831204|601-44-2187""".replace("\n", "|").split("|")
# Rows of the table: each is filled in with TURNS sets of values. What stands in braces is labelled.
TURNS = 4
MARKED = """My name is {person} and I live at {street}.
My name is {person}.
Dear Mr. {person}, thank you for your letter.
Dear Mrs. {person}, we thank you.
Dear Mrs {person},
Please contact {person} for details.
Signed by Dr. {person} on behalf of the board
the report was written by Ms. {person} last year
Name: {person}
Full name: {person}, date of birth: {birth}
Patient: {person}, born {birth}
{person} was born on {birth} in a small town.
She was born on {birth}.
Born: {birth}
Date of birth: {birth}
DOB: {birth}
Address: {street}
Home address: {street}, passport number {number}
He lives at {street} with his family.
Send the parcel to {street}.
Passport no. {number}
passport number: {number}
SSN: {number}
Social security number {number} was on file.
IBAN: {number}
My account number is {number}, please note.
ID card number {number}
Ich heiße {person} und wohne in der {street}.
Mein Name ist {person}.
Sehr geehrter Herr {person},
Sehr geehrte Frau {person},
Anschrift: {street}
Wohnhaft: {street}
geboren am {birth}
Geburtsdatum: {birth}
Reisepass Nr. {number}
Je m'appelle {person} et j'habite {street}.
Nom: {person}
Madame {person}, née le {birth}
Monsieur {person} habite au {street}.
Adresse: {street}
Date de naissance: {birth}
numéro de passeport {number}
Me llamo {person} y vivo en {street}.
Nombre: {person}
Señor {person}, nacido el {birth}
Señora {person}
Dirección: {street}
Fecha de nacimiento: {birth}
Número de pasaporte {number}""".split("\n")
PLAIN = """The name is not known to the board.
The name of the rose is a book about 1327.
Please contact the office for details.
Contact: see below
Names and addresses are kept for 30 days.
The street was empty at 12 that night.
She was born in a small town and lived there.
Passport control opens at 6 on 12 May.
The meeting is on 12.03.2024 at 10:30 in room 4.
Version 2.4.1 was released on 2021-08-14.
Order 4819027 was sent on 3 May 2019.
Chapter 12 deals with the account of the war.
The number is 1024 or 78051120.
Error code X4819027 in module C01.
The Committee on Foreign Affairs met in New York.
In March 1984 the Old Bridge was closed.
Thhati nderst that re, Onhesh an 4501042323994846.
Shonti thand. Ereshan Blethor an of 9807915762804490 the.
That eror atan, Ingly thor. Was ntonti theron is That on.
Thely | Shand | Anhe | 148 | Erinor
Thing### of%%% the&&& Onhaing%%% in. And*** Was&&& from***
The Der Ving Sthan Ereheit an Untz der in Schtz.
Die Schtz Heit in der Verkeit ung Chgeä der Enstverß.
Der Name der Stadt ist nicht bekannt.
Am 12.03.2024 wurde die Straße gesperrt.
Herr und Frau kamen am Abend in die Stadt.
Ver Keit Berölich der Entetz ist Die in enß.
La Rue est longue et le Pont est vieux.
Le nom de la ville est inconnu en 1984.
Elle Tionre la Menté. Queç Oian les È le en Pour est.
El nombre de la ciudad no es conocido.
La Ciónar de los Ñez. Rraboe el Osdoes, y en Mico ieta.
La calle estaba vacía el 12 de mayo.
De 1984 Ciónez 77 el Rrdo y la Boar en Unñ.
Copyright 2019 The Authors. All rights reserved.
Licensed under the Apache License, Version 2.0
Table 4: Results of the Second Trial (n = 221)
1. Introduction
Step 3: Open the File Menu and press Save.
Q: What is the capital? A: Paris
Question 12: What is the name of the King?
Licensed under CC BY-NC 4.0
SPDX-License-Identifier: MIT OR Apache-2.0
Permission is hereby granted, free of charge, to any person.
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND
password = hunter2secret; token: AKIA4819027XQ77
server 10.0.0.1 port 8080 and mail to info@example.com now
call +1 (984) 555-5227 or 030 555 7713 today
He paid 1,600 for 40 books in 2003.
Dear all, please find the notes of May below.
Dr. and Mrs. are titles.
Please send the form to the office before 5 June.""".split("\n")


COMMON = ("de " * 12 + "la " * 8 + "le le les en en el y que del des du au et pour un une the the the a of and of in was at on by for no der die das und am von zu mit").split()
# Rows of made-up and common words in the styles of headings, shouting, lists, repetition and junk, none of them personal data.
NOISE_ROWS, NOISE_SEED = 150, 20240402
NOISE_STYLES = ("lower", "title", "upper", "mixed", "digits")
NOISE_MARKS = (".", ",", "!", "!!", "?", ":", ";", "|", "#", "###", "%%%", "***", "&&&", "$", "-", "/", "(", ")", "'", "+", "@", "_", "=", "<", ">", "\u2019", "")


def noise_rows() -> list[str]:
    rng, rows = Random(NOISE_SEED), []
    for _ in range(NOISE_ROWS):
        styles, marks = rng.choices(NOISE_STYLES, k=2), rng.choices(NOISE_MARKS, k=3) + ["", ""]
        words, common = [], rng.choice((0.0, 0.3, 0.6))
        for _ in range(rng.randint(2, 14)):
            style, word = rng.choice(styles), "".join(rng.choices("aeionrstlhdcäéñß", k=rng.randint(1, 11)))
            if rng.random() < common:
                word = rng.choice(COMMON)
            if style == "digits":
                word = "".join(rng.choices("0123456789", k=rng.choice((1, 2, 3, 4, 4, 8, 16))))
            elif style == "mixed":
                word = "".join(c.upper() if rng.random() < 0.4 else rng.choice((c, c, "7")) for c in word)
            else:
                word = {"lower": word, "title": word.title(), "upper": word.upper()}[style]
            words.append(word + rng.choice(marks))
        at = rng.randrange(len(words))
        rows.append(" ".join(words[:at] + [words[at]] * rng.choice((1, 1, 1, 3, 6, 12)) + words[at + 1 :]))
    return rows


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of every row."""
    values = {"person": PERSONS, "street": STREETS, "birth": BIRTHS, "number": NUMBERS}
    rows, used = [], Counter()
    for turn in range(TURNS):
        for line in MARKED:
            words, labels = [], []
            for part in re.split(r"(\{\w+\})", line):
                kind = part[1:-1] if part.startswith("{") else None
                if kind:
                    own = tokens(values[kind][used[kind] % len(values[kind])])
                    used[kind] += 1
                    labels += [f"{'I' if i else 'B'}-{kind}" for i in range(len(own))]
                else:
                    own = tokens(part)
                    labels += ["O"] * len(own)
                words += own
            rows.append((words, labels))
    return rows + [(tokens(line), ["O"] * len(tokens(line))) for line in PLAIN + noise_rows()]


# --- tokens and features ---------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\n|\S")
# Neighbours whose features count, by their place.
OFFSETS = (-3, -2, -1, 0, 1, 2)
# Words become cues if the table has them so many times outside and within spans, there like Street or Rue.
CUE_COUNT, SPAN_CUE_COUNT = 2, 4


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


_CASES = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})
_RUN = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as X, x and d; one or two characters, or the length of digits, are told apart."""
    if token.isdigit():
        return f"d{min(len(token), 12)}"
    if not token[0].isalpha():
        return token if ord(token[0]) < 128 else "?"
    cased = token.translate(_CASES) if token.isascii() else "".join("X" if c.isupper() else "x" for c in token)
    kinds = _RUN.sub(r"\1", cased)
    return f"{kinds[:4]}{min(len(token), 3)}"


def features(token: str, cues: frozenset[str]) -> list[str]:
    low = token.lower()
    return [f"shape {shape(token)}"] + ([f"word {low}"] if low in cues else [])


# --- the field -------------------------------------------------------------------------------------

L2, STEPS, RATE = 1.0, 80, 0.1
NEVER = -1e4


def allowed_transitions() -> np.ndarray:
    """I follows B or I of its kind only."""
    return np.array([[b[0] != "I" or a[1:] == b[1:] and a != "O" for b in LABELS] for a in LABELS])


def likelihood(emission: np.ndarray, sizes: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels ``gold`` of lines padded to one length, and its gradients by emission and move.

    O stands before and behind every line. Forward and backward sums are brought to a sum of one at every token.
    """
    n, size, k = emission.shape
    rows = np.arange(n)
    live = np.arange(size)[None, :] < sizes[:, None]
    last = np.arange(size)[None, :] == sizes[:, None] - 1
    top = emission.max(axis=2, keepdims=True)
    weight, move = np.exp(emission - top), np.exp(moves)
    ahead, behind, scale = np.zeros((n, size, k)), np.zeros((n, size, k)), np.ones((n, size))
    for t in range(size):
        now = weight[:, t] * (ahead[:, t - 1] @ move if t else move[0])
        scale[:, t] = now.sum(axis=1)
        ahead[:, t] = now / scale[:, t, None]
    behind[:, -1] = move[:, 0]
    for t in range(size - 2, -1, -1):
        now = (weight[:, t + 1] * behind[:, t + 1]) @ move.T
        behind[:, t] = np.where(last[:, t, None], move[:, 0], now / now.sum(axis=1, keepdims=True))
    total = (np.log(scale) + top[:, :, 0])[live].sum() + np.log(ahead[rows, sizes - 1] @ move[:, 0]).sum()
    states = ahead * behind
    states *= live[..., None] / states.sum(axis=2, keepdims=True)
    d_emission, d_moves = -states, np.zeros((k, k))
    d_moves[0] -= states[:, 0].sum(axis=0)
    d_moves[:, 0] -= states[last].sum(axis=0)
    for t in range(1, size):
        on = live[:, t]
        left, right = ahead[on, t - 1], weight[on, t] * behind[on, t]
        d_moves -= move * (left.T @ (right / ((left @ move) * right).sum(axis=1, keepdims=True)))
    row, at = np.nonzero(live)
    own = gold[row, at]
    d_emission[row, at, own] += 1
    before = np.where(at > 0, gold[row, np.maximum(at - 1, 0)], 0)
    np.add.at(d_moves, (before, own), 1)
    np.add.at(d_moves, (gold[last], np.zeros(n, int)), 1)
    score = emission[row, at, own].sum() + moves[before, own].sum() + moves[gold[last], 0].sum() - total
    return float(score), d_emission, d_moves


@dataclass
class Field:
    """Weights of a trained field; scores of each different token are kept while they fit MOST_KNOWN."""

    cues: frozenset[str]
    weights: dict[str, np.ndarray]
    moves: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)
    rows: np.ndarray | None = field(default=None, repr=False, compare=False)

    MOST_KNOWN = 100_000

    def __getstate__(self):
        return {"cues": self.cues, "weights": self.weights, "moves": self.moves}

    def __setstate__(self, state):
        self.__dict__.update(state, known={}, rows=None)

    def scores(self, token: str) -> np.ndarray:
        """Its share in the emissions of the tokens at -OFFSETS from it."""
        own = [self.blocks[f] for f in features(token, self.cues) if f in self.blocks]
        return own[0] if len(own) == 1 else sum(own, np.zeros((len(OFFSETS), len(LABELS)), np.float32))

    @cached_property
    def blocks(self) -> dict[str, np.ndarray]:
        """The weights of a feature at all offsets."""
        out: dict[str, np.ndarray] = {}
        for name, w in self.weights.items():
            offset, feature = name.split(" ", 1)
            out.setdefault(feature, np.zeros((len(OFFSETS), len(LABELS)), np.float32))[OFFSETS.index(int(offset))] = w
        return out

    def number(self, words: list[str]) -> np.ndarray:
        """The place of each token in ``rows`` (offset, token, label); place 0 has no scores."""
        if self.rows is None or len(self.known) > self.MOST_KNOWN:
            self.known, self.rows = {}, np.zeros((len(OFFSETS), 4_096, len(LABELS)), np.float32)
        known = self.known
        for w in set(words).difference(known):
            at = known[w] = len(known) + 1
            if at == self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            self.rows[:, at] = self.scores(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of tokens of many lines, and where line ends stand. Neighbours beyond a line end have no share."""
        ids = self.number(words)
        end = ids == self.known.get("\n", -1)
        ids[end] = 0
        line = np.cumsum(end)
        out = self.rows[OFFSETS.index(0)][ids]
        for i, offset in enumerate(OFFSETS):
            if offset and len(ids) > abs(offset):
                to, of = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
                out[to] += self.rows[i][np.where(line[to] == line[of], ids[of], 0)]
        return out, end

    def stretches(self, emission: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (the last excluded) of every run of tokens that may leave O."""
        stay = self.moves[0, 0]
        into = self.moves[:, 1:].max() - stay
        out_of = max(0.0, self.moves[1:, 0].max() - stay)
        gain = (emission[:, 1:].max(axis=1) - emission[:, 0]).astype(np.float64) + into + out_of
        gain[end] = NEVER
        up = np.concatenate([[0.0], np.cumsum(gain)])
        best = np.maximum.accumulate(up[:0:-1])[::-1] - np.minimum.accumulate(up[:-1])
        open_ = np.concatenate([[False], (best > -1e-6) & ~end, [False]])
        step = np.diff(open_.astype(np.int8))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def viterbi(self, emission: np.ndarray, first: np.ndarray, last: np.ndarray, batch: int = 4_096) -> np.ndarray:
        """The best labels of all tokens, given that those outside first..last are O."""
        labels = np.zeros(len(emission), np.int8)
        order = np.argsort(first - last, kind="stable")
        for at in range(0, len(order), batch):
            a, b = first[order[at : at + batch]], last[order[at : at + batch]]
            sizes = b - a  # falling, so that live stretches are a head of the batch
            size = int(sizes[0])
            score = emission[a] + self.moves[0]
            came = np.zeros((size, len(a), len(LABELS)), np.int8)
            final = np.zeros_like(score)
            for t in range(1, size + 1):
                live = int(np.searchsorted(-sizes, -t, "left"))  # those longer than t
                done = int(np.searchsorted(-sizes, -t, "right"))
                final[live:done] = score[live:done]
                if t < size:
                    step = score[:live, :, None] + self.moves[None]
                    came[t, :live] = step.argmax(axis=1)
                    score = step.max(axis=1) + emission[a[:live] + t]
            here = (final + self.moves[:, 0]).argmax(axis=1)
            for t in range(size - 1, -1, -1):
                on = sizes > t
                labels[a[on] + t] = here[on]
                here = np.where(on, came[t, np.arange(len(a)), here], here)
        return labels

    def decode(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int8)
        emission, end = self.emissions(words)
        first, last = self.stretches(emission, end)
        return self.viterbi(emission, first, last) if len(first) else np.zeros(len(words), np.int8)


def train(rows: list[tuple[list[str], list[str]]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Field:
    """The field of greatest penalised likelihood, by ``steps`` Adam steps over all rows at once."""
    outside = Counter(w.lower() for words, labels in rows for w, label in zip(words, labels) if label == "O" and w[0].isalpha())
    within = Counter(w.lower() for words, labels in rows for w, label in zip(words, labels) if label != "O" and w[0].isalpha())
    cues = frozenset({w for w, n in outside.items() if n >= CUE_COUNT} | {w for w, n in within.items() if n >= SPAN_CUE_COUNT})
    names: dict[str, int] = {}
    hits, places = [], []
    n, size = len(rows), max(len(words) for words, _ in rows)
    for i, (words, _) in enumerate(rows):
        own = [features(w, cues) for w in words]
        for t in range(len(words)):
            places.append((i, t))
            for offset in OFFSETS:
                if 0 <= t + offset < len(words):
                    hits += [(len(places) - 1, names.setdefault(f"{offset} {f}", len(names))) for f in own[t + offset]]
    at, which = np.array(sorted(hits, key=lambda x: x[1])).T
    by_token = np.argsort(at, kind="stable")
    token_start = np.searchsorted(at[by_token], np.arange(len(places)))
    feature_start = np.searchsorted(which, np.arange(len(names)))
    row, column = np.array(places).T
    gold = np.zeros((n, size), int)
    for i, (_, labels) in enumerate(rows):
        gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
    sizes = np.array([len(words) for words, _ in rows])
    fine = allowed_transitions()
    params = [np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))]
    slow, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        emission = np.zeros((n, size, len(LABELS)))
        emission[row, column] = np.add.reduceat(params[0][which[by_token]], token_start)
        _, d_emission, d_moves = likelihood(emission, sizes, np.where(fine, params[1], NEVER), gold)
        grads = [np.add.reduceat(d_emission[row, column][at], feature_start), d_moves * fine]
        for p, g, m, v in zip(params, grads, slow, square):
            g = g - l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {name: params[0][i].astype(np.float32) for name, i in names.items()}
    return Field(cues, weights, np.where(fine, params[1], NEVER).astype(np.float32))


@lru_cache(1)
def default_field() -> Field:
    """Trained once in the driver's process, from the table above."""
    return train(labelled_table())


# --- texts -----------------------------------------------------------------------------------------

CHUNK_CHARS = 500_000
_SPAN = "array<struct<start:int,end:int,kind:string>>"


def chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, str]]:
    """The text in chunks of whole lines, with their places; a line longer than ``limit`` stays whole."""
    at = 0
    while at < len(text):
        cut = len(text)
        if cut - at > limit:
            cut = text.rfind("\n", at, at + limit) + 1 or text.find("\n", at + limit) + 1 or cut
        yield at, text[at:cut]
        at = cut


# A decoded span counts if it has no more tokens than its kind can have and, but for names, a digit.
MOST_TOKENS = {"person": 7, "street": 10, "birth": 8, "number": 14}


def plausible(span: str, kind: str) -> bool:
    return len(tokens(span)) <= MOST_TOKENS[kind] and (kind == "person" or any(c in "0123456789" for c in span))


def field_spans(model: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the spans that the field finds in each text."""
    cut = [tokens(t) for t in texts]
    words: list[str] = []
    for own in cut:
        words += own
        words.append("\n")
    labels = model.decode(words)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not labels.any():
        return out
    first = np.concatenate([[0], np.cumsum([len(own) + 1 for own in cut])])
    for i in np.unique(np.searchsorted(first, np.flatnonzero(labels), "right") - 1):
        for m, label in zip(TOKEN.finditer(texts[i]), labels[first[i] : first[i + 1]].tolist()):
            if label:
                side, kind = LABELS[label].split("-")
                if side == "B":
                    out[i].append((m.start(), m.end(), kind))
                else:
                    out[i][-1] = (out[i][-1][0], m.end(), kind)
        out[i] = [s for s in out[i] if plausible(texts[i][s[0] : s[1]], s[2])]
    return out


def spans_of(model: Field, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Base spans and all spans of each text, by start and then kind as listed."""
    order = {kind: i for i, kind in enumerate(BASE_KINDS + KINDS)}
    part: list[tuple[int, int, str]] = []
    base: list[list] = [[] for _ in texts]
    more: list[list] = [[] for _ in texts]

    def flush():
        for (i, at, _), found in zip(part, field_spans(model, [chunk for _, _, chunk in part])):
            more[i] += [(at + a, at + b, kind) for a, b, kind in found]
        part.clear()

    size = 0
    for i, text in enumerate(texts):
        for at, chunk in chunks(text):
            base[i] += [(at + a, at + b, kind) for a, b, kind in base_spans(chunk)]
            part.append((i, at, chunk))
            size += len(chunk)
            if size >= CHUNK_CHARS:
                flush()
                size = 0
    flush()
    for own, found in zip(base, more):
        free = [s for s in found if not any(b[0] < s[1] and s[0] < b[1] for b in own)] if found else []
        yield own, sorted(own + free, key=lambda s: (s[0], order[s[2]]))


def personal_spans(docs: DataFrame, text: str = "text", name: str = "personal", model: Field | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: base spans and all spans, each (start, end, kind) in code points."""
    model = model or default_field()

    @F.pandas_udf(f"base {_SPAN}, spans {_SPAN}")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            both = list(spans_of(model, [t if t is not None else "" for t in batch]))
            yield pd.DataFrame({k: pd.Series([[{"start": a, "end": b, "kind": kind} for a, b, kind in x[i]] for x in both], dtype=object) for i, k in enumerate(("base", "spans"))})

    return docs.withColumn(name, find(F.col(text)))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the contract for every row of (doc_id, text)."""
    found = personal_spans(docs.select("doc_id", "text")).select("doc_id", "personal.*")
    n = [F.size(F.expr(f"filter(base, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
