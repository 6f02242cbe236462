"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order models over the characters of keys are trained from labelled samples: one
on random strings, one on ordinary identifiers. A candidate token (16 or more characters
of ``A-Za-z0-9+/_=-``, or what the patterns' spans leave of such a token) is a secret of kind
``random`` when its log-likelihood ratio per step is over ``margin`` and in total over ``evidence``;
else each of its parts between ``/``, ``=`` and ``-`` is one if its own is. The default samples are
generated from a fixed seed, so that the models are the same everywhere; pass labelled samples of your own to :func:`train`.

Spans are in code points, end exclusive, and cover the whole match. Defined
cases: null text is empty and has no spans; long texts are scanned whole; null ids are carried and repeated
rows come back each; ties at one start are ordered by kind; an empty table gives an empty
table; other columns, whatever their names, are ignored by the query and kept by :func:`mask_secrets`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, row_slices, text_of

KINDS = ("assign", "access", "hex", "random")
#: Labelled samples of each class that the default models are trained on.
SAMPLES = 4000
#: Log-likelihood ratios over which a token is random: per character step, and in total.
MARGIN, EVIDENCE = 0.35, 10.0
MIN_TOKEN = 16

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# maximal runs, so asking for the length at once finds the same spans
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
_PART = re.compile(r"[^/=-]+")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_WORDS = (
    "account action active address admin agent amount array async audit author avatar backup balance banner batch binary block body "
    "branch bucket buffer build button cache callback cancel catalog category channel check child client close cluster code column "
    "comment commit config connect content context control cookie counter country create current customer data date debug default "
    "delete deploy detail device dialog digest domain draft driver edit element email enable encode engine entry error event example "
    "export factory feature field file filter final finish folder footer format frame function gateway global group handler hash "
    "header height hidden history image import index initial input insert instance integer invoice item iterator label language "
    "layout legacy level license limit link list load local location lock login manager mapping market master match member memory "
    "menu merge message method metric migration mobile model module monitor mount name network node notice number object offer "
    "offset option order origin output owner package page panel parent parser password payment pending percent period phone picture "
    "player plugin policy policies pool position prefix preview price primary print priority private process product profile project "
    "property provider public query queue random range record region release remote render report request reset resource response "
    "result return review role route runner sample schedule schema scope screen script search section select sender server service "
    "session setting shadow shared simple single size snapshot socket source spark stage start state status storage store stream "
    "string style submit summary support switch symbol system table target task template test text theme thread title token tool "
    "total trace track transfer trigger type update upload user utility value vector version video view visible warning web weight "
    "widget width window worker wrapper writer abteilung anschluss aufgabe beispiel bezeichnung einstellung ergebnis fenster funktion "
    "geschichte gesellschaft kunde leitung nachricht netzwerk pflege rechnung schluss sprache stelle verzeichnis zeichen zeitung "
    "adresse affichage beaucoup chemin compte connexion dossier erreur feuille fichier jeux lieu liste niveau nouveau question "
    "quelque reseau tableau travail utilisateur valeur voix archivo busqueda cantidad codigo contenido cuenta direccion empresa "
    "mensaje nombre numero pagina pedido prueba servicio sistema tiempo trabajo usuario ventana"
).split()


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and ``n`` ordinary identifiers (label 0)."""
    rng, out = random.Random(seed), []
    kinds = (_ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[:62] + "_-", _ALPHABET[26:62], _ALPHABET[:26] + "0123456789", "0123456789abcdef")
    for k in range(n):
        out.append(("".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(20, 64))), 1))
    for k in range(n):
        words = [rng.choice(_WORDS) for _ in range(rng.randint(3, 7))]
        if rng.random() < 0.6:
            words.insert(rng.randint(1, len(words)), str(rng.choice((rng.randint(0, 9), rng.randint(10, 999), rng.randint(1990, 2030)))))
        style = k % 6
        if k % 12 == 7:  # a ruled line, whole or with corners, or one character said on and on
            mark = rng.choice("-=_+/") if k % 24 == 7 else rng.choice(_ALPHABET)
            out.append((rng.choice("+-/=_").join([mark * rng.randint(4, 30)] * rng.randint(1, 5)), 0))
            continue
        if k % 24 == 19:  # an option, or a path from the root
            out.append((rng.choice(("--", "-", "//", "/")) + rng.choice("-/").join(words), 0))
            continue
        joined = {0: "_", 1: "-", 2: "/"}.get(style, "").join(w.capitalize() if style == 3 or style == 4 and i else w for i, w in enumerate(words))
        out.append((joined.upper() if style == 0 and k % 4 == 0 else joined, 0))
    return out


class Markov:
    """Log-likelihood ratio of two first-order models over the characters of keys."""

    def __init__(self, ratio: np.ndarray, margin: float, evidence: float):
        self.ratio, self.margin, self.evidence = ratio, margin, evidence

    def score(self, token: str) -> float:
        """Mean ratio per step; over 0 means more like a random string."""
        x = _CODES[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0

    def is_random(self, token: str) -> bool:
        mean = self.score(token)
        return mean > self.margin and mean * (len(token) - 1) > self.evidence


_CODES = np.zeros(256, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODES[ord(_c)] = _i


def train(samples: Iterable[tuple[str, int]], margin: float = MARGIN, evidence: float = EVIDENCE, smooth: float = 0.5) -> Markov:
    """Both models from (string over the key alphabet, 1 random / 0 ordinary) pairs."""
    counts = np.full((2, len(_ALPHABET), len(_ALPHABET)), smooth)
    for text, label in samples:
        x = _CODES[np.frombuffer(text.encode("ascii"), np.uint8)]
        np.add.at(counts[int(label)], (x[:-1], x[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Markov(logs[1] - logs[0], margin, evidence)


@lru_cache(maxsize=1)
def default_model() -> Markov:
    return train(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        # short values still use up their match, so the length is checked afterwards
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _parts(start: int, token: str) -> Iterator[tuple[int, int]]:
    """The stretches of a token between '/', '=' and '-', of MIN_TOKEN characters or more."""
    for m in _PART.finditer(token):
        if len(m[0]) >= MIN_TOKEN:
            yield start + m.start(), start + m.end()


def method_spans(text: str, taken: list[tuple[int, int, int]], model: Markov) -> list[tuple[int, int, int]]:
    out, k, reach = [], 0, 0
    random_at = lambda a, b: b - a >= MIN_TOKEN and model.is_random(text[a:b])
    for m in _TOKEN.finditer(text):
        # what base spans leave of the token
        free, at = [], max(m.start(), reach)
        while k < len(taken) and taken[k][0] < m.end():
            if taken[k][0] > at:
                free.append((at, taken[k][0]))
            reach, k = max(reach, taken[k][2]), k + 1
            at = max(at, reach)
        if at < m.end():
            free.append((at, m.end()))
        for a, b in free:
            if random_at(a, b):
                out.append((a, 3, b))
            else:
                out += [(x, 3, y) for x, y in _parts(a, text[a:b]) if random_at(x, y)]
    return out


def scan(text: str, model: Markov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the models add."""
    base = base_spans(text)
    return base, method_spans(text, base, model)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_scan(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model or default_model()
        for batch in row_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = scan(text, own)
                n = [sum(1 for x in base if x[1] == k) for k in range(3)]
                rows.append((*n, len(more), listed(base), listed(base + more)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def mask_secrets(docs: DataFrame, model: Markov | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; null texts stay null."""
    schema, at = docs.schema, docs.columns.index("text")

    def masked(text: str | None, own: Markov) -> str | None:
        if not text:
            return text
        base, more = scan(text, own)
        out, last = [], 0
        for a, _, b in sorted(base + more):
            if a >= last:
                out += [text[last:a], mask]
            last = max(last, b)
        return "".join([*out, text[last:]]) if last else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model or default_model()
        for batch in row_slices(batches):
            new = pa.array([masked(x, own) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")
