"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns, with failing ones dropped: emails, IPv4 addresses, card
numbers that pass the Luhn test, international phone numbers.

The field has a node for every word with a digit or an @. Its labels are none and the four kinds. Nodes have hashed
features of their shape and of the word before; chain edges join neighbours, and skip edges join the occurrences of equal
or similar words (same letters in any case, same last digits) wherever they stand in the document with one hub per word, so that
any two are two edges apart. Nodes under a base span are observed; loopy sum-product messages carry their labels along the edges
until none changes by more than ``TOLERANCE``, or ``MOST_ROUNDS`` rounds have not settled them. Nodes that get a kind with
probability ``SURE`` are added as spans, neighbours of one kind as one span; they never touch a base span.

Weights are trained on at most ``SAMPLE`` whole documents by gradient steps on the likelihood under the same messages, summed over documents by Spark. Their
labels are the base spans and, for phones, the two national notations of ``NATIONAL``.

Null text is empty. Empty texts have no spans. Repeated rows are read row by row. Without a document that has a node, nothing is
added. Empty tables give no rows; other columns are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import stage, table
from semaspark.llm.words import Texts, chunks

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
BUCKETS = 1024
TOLERANCE = 1e-3
MOST_ROUNDS = 200
SURE = 0.9
STEPS = 150
NEAR = 3
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: what fails there fails further in, and matches end with their run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
NATIONAL = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9-])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE_LEFT, _EDGE_RIGHT = "\"'<>[]{},;:!?.", "\"'<>[](){},;:!?."
_FEATURES = 10
_NODE_BYTE = np.zeros(256, bool)
_NODE_BYTE[[64, *range(48, 58)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried once: before it the run of local characters, behind it a domain with a dot."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Nodes:
    """Words with a digit or an @, in order: row, place among the row's words, span in code points, features, key and label."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    key: np.ndarray
    label: np.ndarray


def _features(word: str, before: str) -> list[int]:
    digits = sum("0" <= c <= "9" for c in word)
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", re.sub(r"[^\W\d_]+", "a", word))
    said = (f"d{min(digits, 20)}", f"@{word.count('@')}", f".{min(word.count('.'), 4)}", f"-{min(word.count('-'), 4)}", f"+{word[:1] == '+'}", f"({word[:1] == '('}",
            f"a{any(c.isalpha() for c in word)}", f"s{shape[:24]}", f"w{before.lower().strip(_EDGE_RIGHT)[:16]}", "bias")
    return [zlib.crc32(x.encode()) % BUCKETS for x in said]


def _key(word: str) -> int:
    """Equal or similar words share it; negative for short ones, which mean less elsewhere."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    if "@" not in word and not any(c.isalpha() for c in word):
        return (zlib.crc32(digits[-7:].encode()) + 1) * (1 if len(digits) >= 7 else -1)
    core = word.lower().strip(_EDGE_RIGHT)
    return (zlib.crc32(core.encode("utf-8", "replace")) + (1 << 33)) * (1 if len(core) >= 6 else -1)


def nodes_of(part: Texts, spans: list[list[tuple[int, int, int]]]) -> Nodes:
    """The nodes of a chunk; label is 1 + kind of the span of ``spans`` that covers a node's middle, else 0."""
    start, end, row = part.words()
    upto = np.concatenate(([0], np.cumsum(_NODE_BYTE[part.data], dtype=np.int64)))
    at = np.flatnonzero(upto[end] > upto[start])
    point = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80, dtype=np.int64)))
    first = np.searchsorted(row, np.arange(part.rows))
    base = point[part.bounds[row[at]]] if len(at) else np.zeros(0, np.int64)
    text = [part.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
    before = ["" if i == first[row[i]] else part.data[start[i - 1] : end[i - 1]].tobytes().decode("utf-8", "replace") for i in at.tolist()]
    cut_left = [len(w) - len(w.lstrip(_EDGE_LEFT)) for w in text]
    cut_right = [len(w) - len(w.rstrip(_EDGE_RIGHT)) for w in text]
    low, high = point[start[at]] - base + np.array(cut_left, np.int64), point[end[at]] - base - np.array(cut_right, np.int64)
    label = np.zeros(len(at), np.int64)
    pointer: dict[int, int] = {}
    for n, (r, a, b) in enumerate(zip(row[at].tolist(), low.tolist(), high.tolist())):
        mine, i = spans[r], pointer.get(r, 0)
        while i < len(mine) and mine[i][2] <= a:
            i += 1
        pointer[r] = i
        for s, kind, e in mine[i : i + 4]:
            if s < b and e > a:
                label[n] = kind + 1
                break
    features = np.array([_features(w, x) for w, x in zip(text, before)], np.int64).reshape(len(at), _FEATURES)
    return Nodes(row[at], at - first[row[at]], low, high, features, np.array([_key(w) for w in text], np.int64), label)


def edges_of(n: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends and type of each edge, and the row of each hub: 0 neighbours, 1 near in the text, 2 a word and the hub of all that equal it
    or are similar, 3 the same for short words. Hubs are numbered after the nodes."""
    one = np.arange(max(len(n.row) - 1, 0))
    gap = n.place[1:] - n.place[:-1]
    close = (n.row[1:] == n.row[:-1]) & (gap <= NEAR)
    order = np.lexsort((n.place, n.key, n.row))
    new = np.ones(len(order), bool)
    new[1:] = (n.key[order][1:] != n.key[order][:-1]) | (n.row[order][1:] != n.row[order][:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group, minlength=1) > 1
    hub = np.cumsum(often) - 1
    mine = often[group] if len(group) else np.zeros(0, bool)
    word, of = order[mine], len(n.row) + hub[group[mine]]
    kinds = np.concatenate((np.where(gap[close] == 1, 0, 1), np.where(n.key[word] > 0, 2, 3)))
    return np.concatenate((one[close], word)), np.concatenate((one[close] + 1, of)), kinds, n.row[order[new]][often] if len(order) else n.row


@dataclass
class Field:
    unary: np.ndarray  # BUCKETS x labels
    pairs: np.ndarray  # edge type x labels x labels

    @staticmethod
    def blank() -> Field:
        n = len(KINDS) + 1
        return Field(np.zeros((BUCKETS, n)), np.zeros((4, n, n)))


def _norm(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def beliefs(field: Field, n: Nodes, edges: tuple[np.ndarray, ...], observed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of nodes, then hubs, and of edges; half of each new message is mixed with the old. A message
    is sent again where it or one that its sender got has changed."""
    a, b, kind, hub_row = edges
    local = field.unary[n.features].sum(1)
    local[observed] = np.where(np.arange(local.shape[1]) == n.label[observed][:, None], 0.0, -30.0)
    local = np.concatenate((local, np.zeros((len(hub_row), local.shape[1]))))
    m = len(a)
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    reverse = np.concatenate((np.arange(m) + m, np.arange(m)))
    both_ways = np.stack((field.pairs, field.pairs.transpose(0, 2, 1)))
    way, kind2 = np.repeat((0, 1), m), np.concatenate((kind, kind))
    message = np.zeros((2 * m, local.shape[1]))
    live, belief = np.arange(2 * m), local.copy()
    for _ in range(MOST_ROUNDS if m else 0):
        z = (belief[source[live]] - message[reverse[live]])[:, :, None] + both_ways[way[live], kind2[live]]
        top = z.max(1, keepdims=True)
        step = 0.5 * (_norm(top[:, 0] + np.log(np.exp(z - top).sum(1))) - message[live])
        message[live] += step
        np.add.at(belief, target[live], step)
        moved = live[np.abs(step).max(1) > TOLERANCE]
        hot = np.zeros(len(local), bool)
        hot[target[moved]] = True
        again = hot[source]
        again[moved] = True
        live = np.flatnonzero(again)
        if not len(live):
            break
    both = (belief[a] - message[m:])[:, :, None] + field.pairs[kind] + (belief[b] - message[:m])[:, None, :]
    return _norm(belief), _norm(both.reshape(m, local.shape[1] ** 2)).reshape(both.shape)


def gradient(field: Field, n: Nodes) -> np.ndarray:
    """Of the log likelihood of the labels, by all weights. A hub has the label that most of its words have, the highest if tied."""
    grads = Field.blank()
    if len(n.row):
        a, b, kind, hub_row = edges = edges_of(n)
        node, both = beliefs(field, n, edges, np.zeros(len(n.row), bool))
        seen = np.zeros((len(hub_row), node.shape[1]))
        words = kind >= 2
        np.add.at(seen, (b[words] - len(n.row), n.label[a[words]]), 1)
        label = np.concatenate((n.label, seen.shape[1] - 1 - seen[:, ::-1].argmax(1))).astype(np.int64)
        wrong = -np.exp(node[: len(n.row)])
        wrong[np.arange(len(wrong)), n.label] += 1
        pair = -np.exp(both)
        pair[np.arange(len(a)), label[a], label[b]] += 1
        for f in n.features.T:
            np.add.at(grads.unary, f, wrong)
        np.add.at(grads.pairs, kind, pair)
    return np.concatenate((grads.unary.ravel(), grads.pairs.ravel()))


def train(gradient_of: Callable[[Field], np.ndarray], steps: int = STEPS, decay: float = 1.0) -> Field:
    """Gradient ascent on the likelihood of the labels, with a scale per weight."""
    shape, like = Field.blank().unary.shape, Field.blank().pairs.shape
    cut = shape[0] * shape[1]
    w = np.zeros(cut + Field.blank().pairs.size)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient_of(Field(w[:cut].reshape(shape), w[cut:].reshape(like))) - decay * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w = w + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    return Field(w[:cut].reshape(shape), w[cut:].reshape(like))


def added_spans(field: Field, n: Nodes, spans: list[list[tuple[int, int, int]]]) -> list[tuple[int, tuple[int, int, int]]]:
    """(row, span) that the field adds."""
    if not len(n.row):
        return []
    node, _ = beliefs(field, n, edges_of(n), n.label > 0)
    node = node[: len(n.row)]
    best = np.where((np.exp(node).max(1) >= SURE) & (n.label == 0), node.argmax(1), 0)
    out: list[tuple[int, tuple[int, int, int]]] = []
    last = -2
    for i in np.flatnonzero(best).tolist():
        row, span = int(n.row[i]), (int(n.start[i]), int(best[i]) - 1, int(n.end[i]))
        if span[2] <= span[0]:
            continue
        if last == i - 1 and out and out[-1][0] == row and out[-1][1][1] == span[1] and n.place[i] == n.place[i - 1] + 1:
            out[-1] = (row, (out[-1][1][0], span[1], span[2]))
        else:
            out.append((row, span))
        last = i
    return [(r, s) for r, s in out if not any(x[0] < s[2] and x[2] > s[0] for x in spans[r])]


def _texts(part: Texts) -> list[str]:
    return [part.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist())]


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


NODE = "place array<int>, features array<int>, key array<long>, label array<int>"


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> Field:
    """The field, trained on the ``sample`` documents with a digit or an @ that have the least hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0)):
                texts = _texts(part)
                spans = [sorted(base_spans(t) + [(m.start(), 3, m.end()) for m in NATIONAL.finditer(t)]) for t in texts]
                n = nodes_of(part, spans)
                cuts = pa.array(np.searchsorted(n.row, np.arange(part.rows + 1)).astype(np.int32))
                wide = pa.array((cuts.to_numpy() * _FEATURES).astype(np.int32))
                values = (n.place.astype(np.int32), n.features.astype(np.int32).ravel(), n.key, n.label.astype(np.int32))
                lists = [pa.ListArray.from_arrays(c, pa.array(v)) for c, v in zip((cuts, wide, cuts, cuts), values)]
                yield pa.RecordBatch.from_arrays(lists, ["place", "features", "key", "label"])

    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(doc_id, text).alias("doc"), F.col(doc_id).alias("id")).orderBy("doc").limit(sample)
    most = some.agg(F.max("doc")).first()[0]
    if most is None:
        return Field.blank()
    # The documents up to the sample's last hash: rows equal to it in id and text count, no row is sent to choose them.
    picked = docs.select(F.xxhash64(doc_id, text).alias("doc"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]") & (F.col("doc") <= most)).dropDuplicates(["doc"])
    spark = docs.sparkSession
    nodes = stage(picked.repartition(spark.sparkContext.defaultParallelism, "doc").select("text").mapInArrow(emit, NODE), "pii_nodes")

    def summed(field: Field) -> np.ndarray:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                place, features, key, label = (batch.column(i) for i in range(4))
                size = np.diff(place.offsets.to_numpy()) if len(place) else np.zeros(0, np.int64)
                zero = np.zeros(int(size.sum()), np.int64)
                flat = [c.flatten().to_numpy().astype(np.int64) for c in (place, features, key, label)]
                some_ = gradient(field, Nodes(np.repeat(np.arange(len(size)), size), flat[0], zero, zero, flat[1].reshape(-1, _FEATURES), flat[2], flat[3]))
                total = some_ if total is None else total + some_
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

        return np.sum([np.frombuffer(r[0]) for r in nodes.mapInArrow(of, "g binary").collect()], 0)

    return train(summed, steps)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base spans and all spans as kind:start:end texts, one row per row."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for part in chunks(texts):
            base = [base_spans(t) for t in _texts(part)]
            every = [list(b) for b in base]
            for row, span in added_spans(sent.value, nodes_of(part, base), base):
                every[row].append(span)
            for b, e in zip(base, every):
                rows.append((*(sum(k == i for _, k, _ in b) for i in range(4)), said(b), said(sorted(e))))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), found(F.col(text)).alias("f")).select("doc_id", "f.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
