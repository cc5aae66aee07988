"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on a small labelled table of token and tag rows and decoded by Viterbi in numpy, many lines at a
time. Its spans that touch a span of the patterns are left out; the patterns' spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Marks at the ends of a token that are no part of its shape.
MARKS = ".,;:!?\"'[]{}<>|#*$%&"
#: Words that say what stands beside them.
CUES = frozenset("at dot (at) [at] (dot) [dot] tel phone call fax mail email e-mail card visa ip host server from".split())
#: Tokens after which a line's scores are set back to a best one of zero, so that they stay exact in a long line.
RESET = 256

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" from left to right; a match around it starts where its run of local characters does."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then by start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _runs(bare: str) -> str:
    """Shape: a for small letters, A for capitals, 0 for digits with the run's length up to 5, marks as they are."""
    shape = re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", bare))
    return re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 5)}>", shape)[:24]


def token_features(token: str) -> list[str]:
    bare = token.strip(MARKS)
    digits = sum(c.isdigit() for c in bare)
    if bare.isalpha():
        shape = "word"
    else:
        shape = _runs(bare)
    bucket = digits if digits <= 4 else "5-8" if digits <= 8 else "9-12" if digits <= 12 else "13-19" if digits <= 19 else "20+"
    found = [f"shape={shape}", f"digits={bucket}", f"dots={min(bare.count('.'), 4)}", "bias"]
    if digits and not bare.strip("0123456789"):
        found.append(f"number={bucket}")
    if "@" in bare:
        found.append("at-sign")
    if bare[:1] in "+(" and digits:
        found.append(f"lead={bare[0]}")
    if (low := token.lower().strip(".,;:")) in CUES:
        found.append(f"cue={low}")
    if any(c.isalpha() for c in bare) and digits:
        found.append("mixed")
    return found


def line_features(tokens: list[str]) -> list[list[str]]:
    own = [token_features(t) for t in tokens]
    out = []
    for i, f in enumerate(own):
        before = [f"-1:{x}" for x in own[i - 1]] if i else ["-1:edge"]
        after = [f"+1:{x}" for x in own[i + 1]] if i + 1 < len(own) else ["+1:edge"]
        out.append(f + before + after)
    return out


@dataclass
class Field:
    """Weights of a feature for each tag, and of a tag after a tag (row: the one before; last row: a line's start)."""

    features: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: an I tag goes on a B or I of its kind only."""
    n = len(TAGS)
    out = np.zeros((n + 1, n), np.float32)
    for j, b in enumerate(TAGS):
        if b[0] == "I":
            out[:, j] = -1e4
            for i, a in enumerate(TAGS):
                if a[2:] == b[2:] and a != "O":
                    out[i, j] = 0
    return out


def train_field(labelled: DataFrame, rounds: int = 250, l2: float = 0.02, most_rows: int = 5_000) -> Field:
    """Fit to rows of tokens array<string> and tags array<string>; at most ``most_rows``, by hash. Adam on the likelihood."""
    rows = labelled.select("tokens", "tags").orderBy(F.xxhash64("tokens"), "tags").limit(most_rows).collect()
    rows = [(r["tokens"], r["tags"]) for r in rows if r["tokens"]]
    names: dict[str, int] = {}
    lines = [[[names.setdefault(f, len(names)) for f in fs] for fs in line_features(list(t))] for t, _ in rows]
    b, longest, s, n = len(rows), max((len(x) for x in lines), default=1), len(TAGS), len(names)
    x = np.zeros((b, longest, n), np.float32)
    gold = np.zeros((b, longest), np.int64)
    mask = np.zeros((b, longest), np.float32)
    for i, (line, (_, tags)) in enumerate(zip(lines, rows, strict=True)):
        for t, fs in enumerate(line):
            x[i, t, fs] = 1
            gold[i, t] = TAGS.index(tags[t])
            mask[i, t] = 1
    w, steps, ok = np.zeros((n, s)), np.zeros((s + 1, s)), _allowed()
    flat = x.reshape(-1, n)
    one = np.eye(s)[gold] * mask[:, :, None]
    gold_steps = np.zeros((s + 1, s))
    np.add.at(gold_steps, (np.full(b, s), gold[:, 0]), 1)
    for t in range(1, longest):
        np.add.at(gold_steps, (gold[:, t - 1], gold[:, t]), mask[:, t])
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    for k in range(1, rounds + 1):
        e = (flat @ w).reshape(b, longest, s)
        tr = steps + ok
        a = np.zeros((b, longest, s))
        z = np.zeros((b, longest, s))
        a[:, 0] = e[:, 0] + tr[s]
        for t in range(1, longest):
            m = a[:, t - 1, :, None] + tr[None, :s]
            top = m.max(1)
            a[:, t] = np.where(mask[:, t, None] > 0, top + np.log(np.exp(m - top[:, None]).sum(1)) + e[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            m = tr[None, :s] + (e[:, t + 1] + z[:, t + 1])[:, None]
            top = m.max(2)
            z[:, t] = np.where(mask[:, t + 1, None] > 0, top + np.log(np.exp(m - top[:, :, None]).sum(2)), 0)
        total = np.log(np.exp(a[:, -1] - a[:, -1].max(1, keepdims=True)).sum(1)) + a[:, -1].max(1)
        p = np.exp(a + z - total[:, None, None]) * mask[:, :, None]
        expected = np.zeros_like(steps)
        expected[s] = p[:, 0].sum(0)
        for t in range(1, longest):
            pair = np.exp(a[:, t - 1, :, None] + tr[None, :s] + (e[:, t] + z[:, t])[:, None] - total[:, None, None])
            expected[:s] += (pair * mask[:, t, None, None]).sum(0)
        grads = (flat.T @ (one - p).reshape(-1, s) - l2 * w, gold_steps - expected - l2 * steps)
        for i, (value, g) in enumerate(zip((w, steps), grads, strict=True)):
            moment[2 * i] = 0.9 * moment[2 * i] + 0.1 * g
            moment[2 * i + 1] = 0.99 * moment[2 * i + 1] + 0.01 * g * g
            value += 0.1 * (moment[2 * i] / (1 - 0.9**k)) / (np.sqrt(moment[2 * i + 1] / (1 - 0.99**k)) + 1e-8)
    return Field(names, w.astype(np.float32), (steps + ok).astype(np.float32))


class Decoder(dict):
    """Token to the number of its class; a class is a set of known features. Class 0 is a line's edge."""

    def __init__(self, field: Field, keep: int = 1 << 20):
        self.field, self.keep = field, keep
        self.classes: dict[tuple[str, ...], int] = {("edge",): 0}
        edge = [self._sum(["edge"], "-1:"), self._sum(["edge"], "+1:")]
        zero = np.zeros(len(TAGS), np.float32)
        self.rows = [[zero], [edge[0]], [edge[1]]]
        self.tables: list[np.ndarray] | None = None

    def _sum(self, features: list[str], prefix: str) -> np.ndarray:
        known = [self.field.features[prefix + f] for f in features if prefix + f in self.field.features]
        return self.field.weights[known].sum(0) if known else np.zeros(len(TAGS), np.float32)

    def __missing__(self, token: str) -> int:
        known = self.field.features
        found = [f for f in token_features(token) if f in known or f"-1:{f}" in known or f"+1:{f}" in known]
        key = tuple(found)
        if (number := self.classes.get(key)) is None:
            number = self.classes[key] = len(self.classes)
            for rows, prefix in zip(self.rows, ("", "-1:", "+1:"), strict=True):
                rows.append(self._sum(found, prefix))
            self.tables = None
        if len(self) >= self.keep:
            self.clear()
        self[token] = number
        return number

    def decode(self, lines: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(line, tags) of the lines that hold any tag but O."""
        sizes = np.array([len(x) for x in lines], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return
        numbers = np.fromiter((self[t] for i in order for t in lines[i]), np.int64)
        if self.tables is None:
            self.tables = [np.array(r, np.float32) for r in self.rows]
        own, before, after = self.tables
        n = sizes[order]
        starts = np.cumsum(np.r_[0, n])[:-1]
        left, right = np.r_[0, numbers[:-1]], np.r_[numbers[1:], 0]
        left[starts] = 0
        right[starts + n - 1] = 0
        e = own[numbers] + before[left] + after[right]
        steps = self.field.steps[:-1]
        back = np.zeros((len(numbers), len(TAGS)), np.int8)
        score = self.field.steps[-1] + e[starts]
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # lines of at least t tokens
        for t in range(1, n[0]):
            k = live[t]
            m = score[:k, :, None] + steps
            best = m.argmax(1)
            at = starts[:k] + t
            back[at] = best
            score[:k] = np.take_along_axis(m, best[:, None], 1)[:, 0] + e[at]
            if t % RESET == 0:
                score[:k] -= score[:k].max(1, keepdims=True)
        tag = np.zeros(len(numbers), np.int8)
        now = score.argmax(1)
        tag[starts + n - 1] = now
        for t in range(int(n[0]) - 1, 0, -1):
            k = live[t]
            at = starts[:k] + t
            tag[at - 1] = back[at, tag[at]]
        any_ = np.add.reduceat((tag > 0).astype(np.int64), starts)
        for k in np.flatnonzero(any_):
            yield int(order[k]), tag[starts[k] : starts[k] + n[k]]


_TOKEN = re.compile(r"\S+")


def _token_lines(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, tokens) of each line, however long."""
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line), line.split()
        at += len(line) + 1


def _entities(tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    start = None
    for i, t in enumerate([*tags, 0]):
        name = TAGS[t]
        if start is not None and name[0] != "I":
            yield TAGS[tags[start]][2:], start, i
            start = None
        if name[0] == "B":
            start = i


def find_spans(texts: list[str], decoder: Decoder) -> list[tuple[list, list]]:
    """For each text its pattern spans and the field's spans that touch none of them, both as (kind, start, end)."""
    base = [base_spans(t) for t in texts]
    owner, where, lines = [], [], []
    for i, t in enumerate(texts):
        for a, b, tokens in _token_lines(t):
            if tokens:
                owner.append(i), where.append((a, b)), lines.append(tokens)
    added: list[list] = [[] for _ in texts]
    for k, tags in decoder.decode(lines):
        i, (a, b) = owner[k], where[k]
        places = [(a + m.start(), m[0]) for m in _TOKEN.finditer(texts[i][a:b])]
        taken = [(s, e) for _, s, e in base[i]]
        for kind, x, y in _entities(tags):
            first, last = places[x], places[y - 1]
            s = first[0] + len(first[1]) - len(first[1].lstrip(MARKS))
            e = last[0] + len(last[1].rstrip(MARKS))
            if s < e and not any(s < q and p < e for p, q in taken):
                added[i].append((kind, s, e))
    return list(zip(base, added, strict=True))


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


def find_personal_data(docs: DataFrame, field: Field, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, base and spans: arrays of (kind, start, end), code points, end exclusive.

    ``spans`` holds ``base`` and what the field adds, each by kind and start. Null and empty texts have none. Texts and
    lines of any length are taken whole. Repeated rows each get a row; of two equally good taggings that of the lower
    tags is taken. Columns that aren't carried may have any name. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    df = docs.select(*carry, F.col("text").alias("__text"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = lambda xs: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(xs, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            base, spans = [], []
            texts = [t or "" for t in batch["__text"].to_pylist()]
            start = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 1 << 20:
                    for b, more in find_spans(texts[start:i], decoder):
                        base.append(order(b))
                        spans.append(order([*b, *more]))
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(base, struct), pa.array(spans, struct)], names=[*carry, "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return df.mapInArrow(run, f"{types}, base {kind}, spans {kind}")


#: The labelled table's lines. In braces: a value of a kind, labelled so; a value in angle brackets is labelled O.
TEMPLATES = (
    "please write to {email} about it", "mail {email} or {email} today", "{email}", "the address {email} was left there", "from {email} on the list",
    "contact {spelled} for more", "email {spelled}", "reach me under {spelled} any time", "write {spelled} please",
    "write {email} or {spelled} today", "or {spelled} and then", "to {spelled}", "with {spelled} of that",
    "call {phone} now", "phone {phone}", "tel {local} after noon", "the number {phone} is new", "fax {local}", "{phone} and {phone}", "of the {phone} that with", "my number is {local} at home",
    "card {card} was charged", "paid with {card} last week", "the of {card} and the", "{card}", "visa {split} until then", "number {split} on the card", "and {card} in that",
    "host {ip} is down", "from {ip} to {ip}", "the server {ip} said", "{ip}", "of and {ip} was in", "ip {ip}",
    "the and of in that was", "<year> was a good year", "on <date> we met", "version <version> is out", "page <small> of <small>", "it cost <price> then", "order <order> has come",
    "token = <hex> stays out", "at <time> in the hall", "chapter <small> begins", "the <year> report and the <small> rules", "Of The That", "WITH AND OF!!", "a | of | the", "see <url> for it",
    "<small> and <year> and <date>", "we saw it at home", "a dot on the map", "at that time the dot was at home", "key <hex> <hex>", "isbn <small>-<small>-<small>", "room <small> tel", "word### and$$$ the%%%",
    "At At At At word", "at at at at at at of", "dot dot dot dot", "at at", "he was at at home dot", "at dot at dot that",
)


def example_rows(copies: int = 6, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled rows: every template ``copies`` times, its values drawn by a fixed seed."""
    rng = np.random.default_rng(seed)
    num = lambda a, b: "".join(str(rng.integers(0, 10)) for _ in range(rng.integers(a, b + 1)))
    word = lambda: "".join(chr(97 + rng.integers(0, 26)) for _ in range(rng.integers(2, 9)))
    host = lambda: f"{word()}{num(0, 2)}.{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
    make = {
        "email": lambda: f"{word()}{rng.choice(['.', '_', ''])}{num(0, 3)}@{host()}",
        "spelled": lambda: f"{word()} {rng.choice(['at', '(at)', '[at]'])} {rng.choice([word(), word(), 'mail', 'host'])} {rng.choice(['dot', '(dot)', '[dot]'])} {rng.choice(['com', 'org', 'net'])}",
        "phone": lambda: rng.choice([f"+{num(1, 2)} ({num(3, 3)}) {num(3, 3)}-{num(4, 4)}", f"+{num(10, 12)}", f"+{num(2, 2)} {num(3, 3)} {num(7, 7)}", f"+{num(1, 1)}-{num(3, 3)}-{num(3, 3)}-{num(4, 4)}"]),
        "local": lambda: rng.choice([f"({num(3, 3)}) {num(3, 3)}-{num(4, 4)}", f"{num(3, 3)}-{num(3, 3)}-{num(4, 4)}"]),
        "card": lambda: num(16, 16) if rng.random() < 0.8 else num(15, 15),
        "split": lambda: rng.choice([" ", "-"]).join(num(4, 4) for _ in range(4)),
        "ip": lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        "year": lambda: str(rng.integers(1900, 2030)), "date": lambda: f"{rng.integers(1990, 2030)}-{num(2, 2)}-{num(2, 2)}", "version": lambda: f"{num(1, 1)}.{num(1, 2)}.{num(1, 2)}", "small": lambda: num(1, 4),
        "price": lambda: f"${num(1, 3)}.{num(2, 2)}", "order": lambda: f"INV-{num(5, 8)}", "hex": lambda: "".join(rng.choice(list("0123456789abcdef")) for _ in range(40)), "time": lambda: f"{num(2, 2)}:{num(2, 2)}",
        "url": lambda: f"https://{host()}/{word()}",
    }
    rows = []
    for template in TEMPLATES:
        for _ in range(copies):
            tokens, tags = [], []
            for part in template.split():
                name = part.strip("{}<>")
                marked = part[0] in "{<" and name in make
                made = make[name]().split() if marked else [part]
                kind = {"spelled": "email", "local": "phone", "split": "card"}.get(name, name)
                tokens += made
                tags += ["O"] * len(made) if not marked or part[0] == "<" else [f"B-{kind}"] + [f"I-{kind}"] * (len(made) - 1)
            if rng.random() < 0.3:
                tokens[-1] += str(rng.choice([".", ",", "!!", "###"]))
            rows.append((tokens, tags))
    return rows


def example_table(spark: SparkSession) -> DataFrame:
    """The small labelled table: tokens and tags of about three hundred lines."""
    return spark.createDataFrame(example_rows(), "tokens array<string>, tags array<string>")
