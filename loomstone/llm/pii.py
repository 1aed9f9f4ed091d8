"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by pattern. The field labels
every token with a digit or an @ (all others are never personal data here) and knows one kind more, `secret`: keys
and passwords. Chain factors join neighbouring tokens; skip factors join each token to the next one of the document
that repeats it, and to the next that resembles it (the same last seven digits however they are written, the same
local part or network), however distant, so that evidence at one mention carries to the others. Marginals come from
loopy sum-product message passing over the documents of a batch at once, each until its own messages settle;
weights are fitted by maximum likelihood with the same message passing on sequences that a fixed generator writes.
Spans of the field that meet no base span are added; base spans stay.

Edge cases. A null text counts as empty: no spans. Repeated rows are searched each. All scans are linear in the
text, however long its runs of digits are. Extra columns stay, and give way where they have a result's name.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstone.llm.common import with_columns_arrow

KINDS = ("email", "ip", "card", "phone")
#: The base's kinds and the field's own one, in the order of the result.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("O", *ALL_KINDS)
# possessive forms of the contract's patterns: what follows a run can never be inside it, so no match is lost
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HIT = re.compile(r"[0-9@]")
GAP = re.compile(r"[\x20\x09-\x0D]")
ASSIGNED = re.compile(r"\w[\w-]*[=:]")
Span = tuple[str, int, int]
#: Digits of spans that may go on over white space.
MOST_DIGITS = {"card": 19, "phone": 15}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from the first character of the run before an @, which must be able to start one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            end = m.end()
            out.append((start, end))
        at, end = text.find("@", max(at + 1, end)), max(end, at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind as listed and then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def hit_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the tokens between white space that hold a digit or an @."""
    end = 0
    while m := HIT.search(text, end):
        start = m.start()
        while start > end and not GAP.match(text, start - 1):
            start -= 1
        end = g.start() if (g := GAP.search(text, m.end())) else len(text)
        yield start, end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field -------------------------------------------------------------------------------------------

CUES = {"email": "email e-mail mail contact correo courriel", "ip": "ip host server address addr", "card": "card visa mastercard amex carte tarjeta karte", "phone": "phone tel call mobile fax telefon téléphone teléfono", "secret": "token secret password passwd pwd key apikey api_key api-key passwort clave contraseña"}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
SHAPES: list[tuple[str, re.Pattern]] = [
    (name, re.compile(p))
    for name, p in (
        ("email", r".+@[\w-]+(\.[\w-]+)+\W*"), ("at", r".*@.*"), ("quad", r"\D?\d{1,3}(\.\d{1,3}){3}(:\d+)?\W*"), ("plus", r"\+\d+"), ("area", r"\(\d{2,4}\)"),
        ("local", r"\d{3}-\d{4}\W*"), ("full", r"(\d{3}[-.]){2}\d{4}\W*"), ("d1-3", r"\d{1,3}\W*"), ("d4", r"\d{4}\W*"), ("d5-8", r"\d{5,8}\W*"), ("d9-12", r"\d{9,12}\W*"), ("d13-19", r"\d{13,19}\W*"),
        ("d20", r"\d{20,}\W*"), ("mixed", r".*[A-Za-z].*"), ("equals", r".*=.*"), ("decimal", r"\d+[.,:/]\d+\W*"), ("date", r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\W*"), ("version", r"v?\d+(\.\d+){2}\W*"), ("dotted", r"\d{3}[. -]\d{3}[. -]\d{4}\W*"),
        ("hex", r"\W*(?=[a-fA-F0-9]*[a-fA-F])[a-fA-F0-9]{24,}\W*"), ("key", r"\W*[A-Z]{3,}[0-9A-Z_-]{10,}\W*"), ("assigned", r"\w+[=:]\S{6,}"),
    )
]
FEATURES = ["bias", *(f"shape {n}" for n, _ in SHAPES), "luhn", *(f"cue {k}" for k in ALL_KINDS), *(f"base {k}" for k in KINDS)]
AT = {f: i for i, f in enumerate(FEATURES)}
#: Rounds of messages in training; a text gets two more for each of its tokens, as messages are damped.
ROUNDS = 12


def token_features(token: str, cue: str | None, base: str | None) -> list[int]:
    out = [0, *(AT[f"shape {n}"] for n, p in SHAPES if p.fullmatch(token))]
    digits = "".join(c for c in token if c in "0123456789")
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append(AT["luhn"])
    if cue:
        out.append(AT[f"cue {cue}"])
    if base:
        out.append(AT[f"base {base}"])
    return out


#: Kinds of factors.
CHAIN, REPEAT, SIMILAR = range(3)
EDGES = " \t.,;:!?()[]<>{}\"'#*$%&|+"


def link_keys(token: str) -> list[tuple[int, str]]:
    """(kind, key): tokens that share one repeat or resemble one another."""
    bare = token.strip(EDGES).lower()
    digits = "".join(c for c in bare if c in "0123456789")
    if "@" in bare:
        local = bare.partition("@")[0]
        return [(REPEAT, bare), (SIMILAR, f"@{local}")] if local else []
    if len(digits) < 4:
        return []
    out = [(REPEAT, bare)]
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", bare):
        out.append((SIMILAR, bare.rpartition(".")[0]))
    elif len(digits) >= 7 and not any(map(str.isalpha, bare)):
        out.append((SIMILAR, digits[-7:]))
    return out


def cue_of(text: str, start: int, least: int, token: str) -> str | None:
    """The kind that the word before a token names, however far it is within the text behind `least`, or that the token
    itself assigns to."""
    if (name := re.match(r"(\w[\w-]*)[=:]", token)) and (kind := CUE_OF.get(name[1].lower())):
        return kind
    end = start
    while end > least and not text[end - 1].isalnum():
        end -= 1
    at = end
    while at > least and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return CUE_OF.get(text[at:end].lower())


@dataclass
class Graph:
    """Tokens of many documents: feature lists, and the factors between tokens (first, second, kind)."""

    features: list[list[int]]
    edges: list[tuple[int, int, int]]

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.features), len(FEATURES)))
        for i, f in enumerate(self.features):
            out[i, f] = 1
        return out


@dataclass
class Weights:
    node: np.ndarray
    pair: np.ndarray  # by kind of factor


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(x: np.ndarray, edges: np.ndarray, w: Weights, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge marginals by loopy sum-product, all messages of a round at once, damped after four rounds.

    owner: the document of each node, from 0; None in training, where all end after ROUNDS. A document's messages end when they settle, or after ROUNDS
    and two rounds for each of its tokens, so its result does not depend on the documents beside it.
    """
    node = x @ w.node
    if not len(edges):
        return np.exp(node - log_sum(node, 1)[:, None]), np.zeros((0, len(LABELS), len(LABELS)))
    i, j, pair = edges[:, 0], edges[:, 1], w.pair[edges[:, 2]]
    one = owner is None
    owner = np.zeros(len(node), np.int64) if one else owner
    doc, most = owner[i], np.full(1, ROUNDS) if one else ROUNDS + 2 * np.bincount(owner)
    to_i, to_j = (np.zeros((len(edges), len(LABELS))) for _ in range(2))

    def beliefs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        belief = node.copy()
        np.add.at(belief, j, to_j)
        np.add.at(belief, i, to_i)
        return belief, belief[i] - to_i, belief[j] - to_j

    live = np.ones(len(edges), bool)
    for r in range(most.max()):
        at = np.flatnonzero(live)
        if not len(at):
            break
        _, from_i, from_j = beliefs()
        new_j = log_sum(from_i[at][:, :, None] + pair[at], 1)
        new_i = log_sum(from_j[at][:, None, :] + pair[at], 2)
        new_j -= log_sum(new_j, 1)[:, None]
        new_i -= log_sum(new_i, 1)[:, None]
        moved = np.zeros(len(most))
        np.maximum.at(moved, doc[at], np.maximum(np.abs(new_j - to_j[at]).max(axis=1), np.abs(new_i - to_i[at]).max(axis=1)))
        keep = 0.3 if r >= 4 else 0.0
        to_j[at], to_i[at] = keep * to_j[at] + (1 - keep) * new_j, keep * to_i[at] + (1 - keep) * new_i
        live = ((moved >= 1e-4) & (r + 1 < most))[doc]
    belief, from_i, from_j = beliefs()
    both = from_i[:, :, None] + from_j[:, None, :] + pair
    both -= both.max(axis=(1, 2), keepdims=True)
    both = np.exp(both)
    return np.exp(belief - log_sum(belief, 1)[:, None]), both / both.sum(axis=(1, 2), keepdims=True)


def link(tokens: list[str], first: int, edges: list[tuple[int, int, int]], near: list[bool]) -> None:
    """Chain factors where near[k] (token k follows its neighbour), skip factors to the last token that shares a key."""
    seen: dict[tuple[int, str], int] = {}
    for k, t in enumerate(tokens):
        if near[k]:
            edges.append((first + k - 1, first + k, CHAIN))
        met = set()
        for key in link_keys(t):
            if key in seen and seen[key] not in met:
                edges.append((first + seen[key], first + k, key[0]))
                met.add(seen[key])
            seen[key] = k


def training_documents(n: int = 600, seed: int = 7) -> tuple[Graph, list[int]]:
    """Labelled token runs written by a fixed generator: plain numbers, codes and dates beside personal data."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def noise() -> list[tuple[str, int]]:
        one = rng.choice((f"{digits(3)}.{digits(3)}.{digits(4)}", digits(10), digits(16), digits(1), digits(2), digits(3), digits(4), digits(5), digits(8), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(2)},{digits(2)}", digits(22), digits(14), f"x{digits(3)}", "@", f"@{digits(3)}", f"{digits(1)}%"))
        return [(one, 0)] * rng.choice((1, 1, 1, 2))

    def secret() -> tuple[str, bool]:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((26, 32, 40, 64))))
        capitals = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        return rng.choice(((f'"{hexes}"', True), (hexes, True), (f"password={hexes[:12]}", False), (f"token={hexes}", False), (f"AKIA{capitals[:14]}1", True), (f"{hexes[:10]}7", True)))

    def phone(d: str) -> list[str]:
        return rng.choice(([f"({d[:3]})", f"{d[3:6]}-{d[6:]}"], [f"{d[:3]}.{d[3:6]}.{d[6:]}"], [d], [f"{d[:3]}-{d[3:6]}-{d[6:]}"], [f"{d[3:6]}-{d[6:]}"]))

    graph, labels = Graph([], []), []
    for _ in range(n):
        runs: list[tuple[list[tuple[str, int]], str | None, str | None]] = [(noise(), None, None) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice(ALL_KINDS)
            y, base, cue = LABELS.index(kind), kind if rng.random() < 0.7 and kind != "secret" else None, kind if rng.random() < 0.3 else None
            if kind == "email":
                name = f"u{digits(3)}.{digits(2)}"
                run = [(f"{name}@mail{digits(1)}.example.com", y)] if base else [(f"{name}@host{digits(1)}", y)]
            elif kind == "ip":
                run = [(".".join(str(rng.randint(0, 255)) for _ in range(4)), y)]
            elif kind == "card":
                c = card()
                run = [(c, y)] if base or rng.random() < 0.5 else [(c[i : i + 4], y) for i in range(0, 16, 4)]
            elif kind == "secret":
                one, bare = secret()
                # short ones are known by the word before them only
                cue = kind if not bare or len(one) < 20 or rng.random() < 0.7 else None
                run = [(one, y)]
            else:
                d = digits(10)
                cue = cue or (None if base else kind)
                run = [(f"+{digits(1)}", y), (f"({d[:3]})", y), (f"{d[3:6]}-{d[6:]}", y)] if base else [(t, y) for t in phone(d)]
            runs.append((run, base, cue))
            for _ in range(rng.choice((0, 1, 1, 2))):
                again = [(t, y) for t in phone(d)] if kind == "phone" else [run[-1]] if kind == "email" or len(run) == 1 else run
                runs.append((again, None, None))
        rng.shuffle(runs)
        tokens, near, first = [], [], len(labels)
        for run, base, cue in runs:
            for k, (t, y) in enumerate(run):
                tokens.append(t)
                near.append(k > 0)
                labels.append(y)
                graph.features.append(token_features(t, cue if k == 0 else None, base))
        link(tokens, first, graph.edges, near)
    return graph, labels


@cache
def trained(steps: int = 100, rate: float = 0.5, penalty: float = 2e-4) -> Weights:
    """Maximum likelihood by gradient ascent with momentum; expected counts come from the marginals."""
    graph, labels = training_documents()
    x, edges, y = graph.matrix(), np.array(graph.edges), np.eye(len(LABELS))[labels]
    n = len(labels)
    w = Weights(np.zeros((len(FEATURES), len(LABELS))), np.zeros((3, len(LABELS), len(LABELS))))
    seen = np.zeros_like(w.pair)
    np.add.at(seen, edges[:, 2], y[edges[:, 0]][:, :, None] * y[edges[:, 1]][:, None, :])
    v = Weights(np.zeros_like(w.node), np.zeros_like(w.pair))
    for _ in range(steps):
        p, q = marginals(x, edges, w)
        expected = np.zeros_like(w.pair)
        np.add.at(expected, edges[:, 2], q)
        v.node = 0.9 * v.node + x.T @ (y - p) / n - penalty * w.node
        v.pair = 0.9 * v.pair + (seen - expected) / n - penalty * w.pair
        w.node, w.pair = w.node + rate * v.node, w.pair + rate * v.pair
    return w


def find_all(texts: list[str | None], weights: Weights, least: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    graph, where = Graph([], []), []  # where: (text, start, end, follows the token before)
    for n, t in enumerate(texts):
        if not t or not HIT.search(t):
            continue
        tokens, near, first, last, cover = [], [], len(where), 0, sorted((a, b, k) for k, a, b in base[n])
        c = 0
        for a, b in hit_tokens(t):
            while c < len(cover) and cover[c][1] <= a:
                c += 1
            kind = cover[c][2] if c < len(cover) and cover[c][0] < b else None
            cue = cue_of(t, a, last, t[a:b])
            near.append(bool(tokens) and a - last == 1)
            tokens.append(t[a:b])
            where.append((n, a, b, near[-1]))
            graph.features.append(token_features(tokens[-1], cue, kind))
            last = b
        link(tokens, first, graph.edges, near)
    out = [(b, list(b)) for b in base]
    if where:
        owner = np.unique([n for n, *_ in where], return_inverse=True)[1]
        p, _ = marginals(graph.matrix(), np.array(graph.edges, dtype=int).reshape(-1, 3), weights, owner)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        runs: list[list] = []
        for (n, a, b, near), label, q in zip(where, best.tolist(), sure.tolist(), strict=True):
            if label and q >= least:
                # parts of one number, not one number after another
                joins = near and runs and runs[-1][0] == n and runs[-1][1] == label and runs[-1][3] == a - 1
                if joins and sum(map(str.isdigit, texts[n][runs[-1][2] : b])) <= MOST_DIGITS.get(LABELS[label], 0):
                    runs[-1][3] = b
                else:
                    runs.append([n, label, a, b])
        for n, label, a, b in runs:
            t = texts[n]
            if LABELS[label] == "secret" and (name := ASSIGNED.match(t, a, b)):
                a = name.end()
            while a < b and not (t[a].isalnum() or t[a] in "+("):
                a += 1
            while b > a and not (t[b - 1].isalnum() or t[b - 1] == ")"):
                b -= 1
            if a < b and all(b <= x or a >= y for _, x, y in base[n]):
                out[n][1].append((LABELS[label], a, b))
    for _, spans in out:
        spans.sort(key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2]))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of spans that meet, replaced by its first kind's name."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]


def find_pii(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """df with the base's counts and base_sha256, all spans and their number; with redact also the column `redacted`. Row-wise, no shuffle."""
    weights = trained()
    fields = [*FIELDS, *([T.StructField("redacted", T.StringType())] if redact else [])]

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(text).to_pylist()
            found = [x for k in range(0, len(texts), 256) for x in find_all(texts[k : k + 256], weights)]
            out = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            out["spans"] = pa.array([joined(spans) for _, spans in found], pa.string())
            out["n_spans"] = pa.array([len(spans) for _, spans in found], pa.int64())
            if redact:
                out["redacted"] = pa.array([t and redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            return out

        return run

    return with_columns_arrow(df, make, fields)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
