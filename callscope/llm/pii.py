"""Personal data: patterns, and a skip-chain conditional random field on top.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  What they
find is certain; the field then looks for other mentions of the same things in
the same document, which no pattern matches: a card number with a digit glued
to it, the last part of a phone number, a mail address without its ending.

Its nodes are a document's tokens with a digit or an @; other tokens can't carry
a label.  Neighbours share a chain potential, and distant tokens with the same
or similar letters and digits share a skip potential, so labels spread along
mentions.  Edges join each mention to the next, never all to all, and to the
nearest observed mention, so no distance weakens a label.  Loopy sum-product
message passing until it settles gives the marginals; tokens in a pattern's
match are observed.  A token is added if its likeliest label is one that an observed
mention linked to it by skip edges bears: without a mention to be consistent
with, nothing is added, so documents without personal data are left alone.

The weights are trained by pseudo-likelihood on the patterns' labels.  The
features are few and discrete, so counts of their combinations over all
documents are sufficient; they are added up in Spark, and the maximum is found
from a table of combinations.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import in_slices, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9A-Za-z._%+@-]+")
SIMILAR = 10  # tokens that agree in so many first letters and digits are similar

Span = tuple[str, int, int]


# ---- patterns --------------------------------------------------------------

def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain; found from each @, so the time is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        begin = at - (len(before) - len(before.rstrip(LOCAL)))
        free = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Spans (kind, begin, end) in the order of KINDS, then begin; code points, end exclusive."""
    found: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# ---- the field's graph -----------------------------------------------------

class Graph:
    """Tokens of a document with their observed labels (-1: none), chain edges, and skip edges with a strength from 0 to 2.

    Mentions of under four letters and digits are alike by chance too often, so they get no skip edge.
    Edges in ``far`` join a mention to the nearest observed one, where no skip edge does; training takes no note of them.
    """

    def __init__(self, text: str, spans: list[Span]):
        self.spans, self.begin, self.end, self.shape, forms = [], [], [], [], []
        for m in TOKEN.finditer(text) if MARK.search(text) else ():
            raw = m[0]
            if not MARK.search(raw):
                continue
            begin = m.start() + len(raw) - len(raw.lstrip("._%+-"))
            core = raw.strip("._%+-")
            form = re.sub("[^0-9a-z@]", "", core.lower())
            digits = sum(map(str.isdigit, form))
            self.begin.append(begin)
            self.end.append(begin + len(core))
            self.shape.append((min(digits, 20), "@" in core, min(core.count("."), 4), digits < len(form), text[max(0, begin - 1):begin] == "+"))
            forms.append(form)
        n = len(forms)
        self.label = np.full(n, -1)
        for kind, begin, end in spans:
            lo, hi = np.searchsorted(self.end, begin, "right"), np.searchsorted(self.begin, end, "left")
            self.label[lo:hi] = LABELS.index(kind)
        self.chain = [(i, i + 1) for i in range(n - 1) if self.begin[i + 1] - self.end[i] <= 3]
        self.skip: list[tuple[int, int, int]] = []
        self.far: list[tuple[int, int, int]] = []
        last: dict[str, int] = {}
        observed: dict[str, list[int]] = {}
        for i, form in enumerate(forms):
            near = last.get(form)
            if len(form) >= 4 and near is not None:
                self.skip.append((near, i, 0 if len(form) < 7 else 1 if len(form) < 11 else 2))
            similar = "~" + form[:SIMILAR]
            if len(form) >= SIMILAR and last.get(similar) not in (None, near):
                self.skip.append((last[similar], i, 1))
            last[form] = last[similar] = i
            if self.label[i] >= 0:
                for key in (form, similar):
                    observed.setdefault(key, []).append(i)
        joined = {e[:2] for e in self.skip}
        for i, form in enumerate(forms) if observed else ():
            if self.label[i] >= 0 or len(form) < 4:
                continue
            for key, strength in ((form, 0 if len(form) < 7 else 1 if len(form) < 11 else 2), ("~" + form[:SIMILAR], 1)):
                held = observed.get(key, []) if key == form or len(form) >= SIMILAR else []
                if held:
                    at = bisect.bisect(held, i)
                    near = min(held[max(0, at - 1):at + 1], key=lambda j: abs(j - i))
                    edge = (min(near, i), max(near, i))
                    if edge not in joined:
                        self.far.append((*edge, strength))
                    break

    def supported(self) -> np.ndarray:
        """(token, label): an observed mention with this label is reached by skip edges."""
        n = len(self.label)
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b, _ in self.skip:
            root[find(a)] = find(b)
        roots = np.array([find(i) for i in range(n)], int)
        has = np.zeros((n, len(LABELS)), bool)
        seen = self.label >= 0
        has[roots[seen], self.label[seen]] = True
        return has[roots]


# ---- training --------------------------------------------------------------

SIZES = {"shape": 7 * 2 * 5 * 2 * 2, "left": 5, "right": 5, "skip": 3 * 5}
OFFSETS = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])))
WIDTH = sum(SIZES.values()) + 1  # the last one: no neighbour of the sort


def _shape_code(shape: tuple) -> int:
    digits, at, dots, letters, plus = shape
    bucket = int(np.searchsorted((1, 4, 7, 11, 16, 20), digits, "right"))
    return (((bucket * 2 + at) * 5 + dots) * 2 + letters) * 2 + plus


def examples(graph: Graph) -> Iterator[tuple[int, int, int, int, int]]:
    """(label, shape, left, right, skip) codes of each token; neighbours' codes are -1 where there is none."""
    label = np.maximum(graph.label, 0).tolist()
    left, right, skip = {}, {}, {}
    for a, b in graph.chain:
        left[b], right[a] = label[a], label[b]
    for a, b, strength in graph.skip:
        skip[a] = max(skip.get(a, -1), strength * 5 + label[b])
        skip[b] = max(skip.get(b, -1), strength * 5 + label[a])
    for i, y in enumerate(label):
        yield y, _shape_code(graph.shape[i]), left.get(i, -1), right.get(i, -1), skip.get(i, -1)


def prior() -> np.ndarray:
    """Where the weights rest without data: most tokens are other, mentions agree."""
    w = np.zeros((WIDTH, len(LABELS)))
    w[:SIZES["shape"], 0] = 1.0
    for strength in range(3):
        for y in range(1, len(LABELS)):
            w[OFFSETS["skip"] + strength * 5 + y, y] = 2.0 + strength
    return w


def fit(counts: list[tuple[int, int, int, int, int, int]], steps: int = 300, pull: float = 1.0) -> np.ndarray:
    """Weights (feature, label) that maximise the pseudo-likelihood of counted examples, pulled to the prior."""
    start = prior()
    if not counts:
        return start
    table = np.array(sorted(counts), "i8")
    y, n = table[:, 0], table[:, 5].astype("f8")
    columns = np.stack([
        table[:, 1], *(np.where(table[:, k] >= 0, OFFSETS[name] + table[:, k], WIDTH - 1) for k, name in ((2, "left"), (3, "right"), (4, "skip")))], 1)
    w, speed, size = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):  # Adam over the whole table
        logits = w[columns].sum(axis=1)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad = pull * (w - start)
        for k in range(columns.shape[1]):
            np.add.at(grad, columns[:, k], p * n[:, None])
        grad /= n.sum()
        grad[WIDTH - 1] = 0
        speed, size = 0.9 * speed + 0.1 * grad, 0.99 * size + 0.01 * grad ** 2
        w -= 0.1 * (speed / (1 - 0.9 ** step)) / (np.sqrt(size / (1 - 0.99 ** step)) + 1e-9)
    return w


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Count feature combinations over every document, then fit; the counts have a row per combination seen."""

    def count(batches):
        for batch in in_slices(batches, 2000):
            held: dict[tuple, int] = {}
            for text in batch.column(0).to_pylist():
                if MARK.search(text):
                    for e in examples(Graph(text, pattern_spans(text))):
                        held[e] = held.get(e, 0) + 1
            columns = list(zip(*((*k, v) for k, v in held.items()))) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*"ysabkn"])

    seen = docs.select(utf8(F.col(text_col)).alias("text")).mapInArrow(count, "y long, s long, a long, b long, k long, n long")
    return fit([tuple(r) for r in seen.groupBy(*"ysabk").agg(F.sum("n").alias("n")).collect()])


# ---- inference -------------------------------------------------------------

def marginals(graph: Graph, w: np.ndarray, rounds: int | None = None, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product message passing until it settles; (token, label).

    A message goes one edge a round; without ``rounds``, the bound on them grows with the graph.
    """
    k, skips = len(LABELS), graph.skip + graph.far
    rounds = 20 + 2 * len(graph.label) if rounds is None else rounds
    unary = w[[_shape_code(s) for s in graph.shape]]
    seen = graph.label >= 0
    unary[seen] = -50.0
    unary[seen, graph.label[seen]] = 0.0
    chain = w[OFFSETS["left"]:OFFSETS["left"] + 5] + w[OFFSETS["right"]:OFFSETS["right"] + 5].T  # (left label, right label)
    skip = w[OFFSETS["skip"]:OFFSETS["skip"] + 15].reshape(3, 5, 5)
    skip = skip + skip.transpose(0, 2, 1)
    ends = np.array([e[:2] for e in (*graph.chain, *skips)], int).reshape(-1, 2)
    pots = np.concatenate([np.repeat(chain[None], len(graph.chain), 0), skip[[e[2] for e in skips]]]) if len(ends) else np.zeros((0, k, k))
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])  # [edge, source label, target label]
    twin = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    messages = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        sent = (belief[source] - messages[twin])[:, :, None] + pots
        top = sent.max(axis=1, keepdims=True)
        new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - messages).max(initial=0)
        messages = damping * messages + (1 - damping) * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[Span], w: np.ndarray) -> list[Span]:
    """Spans that the field adds; they overlap no pattern's span."""
    graph = Graph(text, spans) if spans else None
    if graph is None or not graph.skip or (graph.label >= 0).all():
        return []
    supported = graph.supported()
    free = (graph.label < 0) & supported[:, 1:].any(axis=1)
    if not free.any():
        return []
    p = marginals(graph, w)
    best = p.argmax(axis=1)
    taken = free & (best > 0) & supported[np.arange(len(best)), best]
    return [(LABELS[best[i]], graph.begin[i], graph.end[i]) for i in np.flatnonzero(taken).tolist()]


def find(text: str, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans; each in the order of KINDS, then begin."""
    base = pattern_spans(text)
    more = added_spans(text, base, w)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find_personal_data(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and spans: all of them.

    Spans are written kind:start:end, code points with end exclusive, by kind
    and then start, joined by commas.  Null texts count as empty; repeated rows
    and null ids are kept; an empty table gives no rows (and the prior's
    weights); other columns are ignored.  Row-local after training.
    """
    w = train(docs, text_col) if weights is None else weights

    def scan(batches):
        for batch in in_slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text, w)
                kinds = [s[0] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    schema = T.StructType([
        source.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    names = schema.names
    return source.mapInArrow(scan, schema)


def redacted(text: str, w: np.ndarray) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans, the earliest and longest."""
    out, at = [], 0
    for kind, begin, end in sorted(find(text, w)[1], key=lambda s: (s[1], -s[2])):
        if end > at:
            if begin >= at:
                out += [text[at:begin], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind in brackets.

    Null texts stay null and empty ones empty; all rows and columns stay, repeated
    ones too; an empty table gives no rows.  If ``length_col`` is given
    and there, it is set to the new text's length.
    """
    w = train(docs, text_col) if weights is None else weights
    at = docs.columns.index(text_col)

    def replace(batches):
        for batch in in_slices(batches):
            new = [None if t is None else redacted(t, w) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(new, pa.string()))

    out = docs.mapInArrow(replace, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
