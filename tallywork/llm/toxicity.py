"""Toxicity of texts behind leetspeak, spacing and repetition: noisy-channel decoding, then a linear model.

A character model of order four is counted over all documents.  A token that may be disguised (a sign that stands for a
letter, a filler, a letter three times in a row, letters apart), hex strings and numbers excepted, becomes a lattice: each place offers the letters that it may stand for, at
the cost of the channel, and a Viterbi search takes the path that channel and character model together like best.
Other tokens have one path only, themselves.  The restored words and their beginnings are the features of a logistic
model with weights of at least zero, fitted on a bounded sample of labelled rows, one for each group of near copies.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, text_bytes
from .passages import SEEDS, mixed, shingle_hashes

#: Symbols of the character model: 0 parts words, 1-26 are a-z, 27 is any other letter.
N = 28
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC0:] = 27
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that may stand between the letters of a word.
FILLERS = ".-_*~'`^:,/\\ "
#: log10 costs of the channel: a sign for a letter, a sign as itself, a filler left out, a filler as the end of a word, a letter of a run dropped.
SUBSTITUTE, LITERAL, DROP, PART, SHORTEN = -0.5, -2.0, -0.2, -1.0, -0.1

_SIGNS = "".join(map(re.escape, LEET))
_MARK = re.compile(rf"[{_SIGNS}{re.escape(FILLERS.strip())}]|([^\W\d_])\1\1")
_APART = re.compile(rf"(?<!\S)(?:[^\W_{_SIGNS}]|[{_SIGNS}])(?: +(?:[^\W_{_SIGNS}]|[{_SIGNS}])){{2,}}(?!\S)")
_EDGE = " \t\r\n.,;:?\"'()[]{}<>*#%&~-_=`^/\\"
#: Tokens that are no words: hex strings, and numbers with their separators, signs and units.
_HEX = re.compile(r"[0-9a-f]{16,}")
_NUMBER = re.compile(r"[+$€£]?[0-9][0-9.,:/_~*'-]*[$€£+]?")
_RUN = re.compile(r"(.)\1{3,}", re.S)


def _char(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _spells(text: str) -> bool:
    """Whether signs may be a word: two different ones, not all of them digits."""
    found = {c for c in text if c.isalpha() or c in LEET}
    return len(found) > 1 and not all(map(str.isdigit, found))


def _parts(batches, size: int = 1 << 22):
    """The texts of a task, parted by line ends, in pieces of about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        for raw in b.column(0):
            raw = raw.as_py()
            held.append(raw)
            n += len(raw)
            if n >= size:
                whole = b"\n".join(held) + b"\n"
                yield from (whole[i : i + size] for i in range(0, len(whole), size))
                held, n = [], 0
    if held:
        yield b"\n".join(held) + b"\n"


def count_characters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each four symbols follow one another, over all texts; at most 28**4 rows."""
    skip = np.full(256, 255, np.uint8)  # the further bytes of a character
    skip[:0x80], skip[0xC0:] = _SYMBOL[:0x80], _SYMBOL[0xC0:]

    def run(batches):
        total = np.zeros(N**4, np.int64)
        last = np.zeros(3, np.uint8)  # the texts of a task are one stream, a boundary after each
        for part in _parts(batches):
            s = skip[np.frombuffer(part, np.uint8)]
            s = np.concatenate([last, s[s != 255]])
            letter = s != 0
            s = s[np.concatenate([[True] * 3, letter[3:] | letter[2:-1]])]  # one boundary between words
            if len(s) > 3:
                two = s[:-1] * np.uint32(N)
                two += s[1:]
                four = two[:-2] * np.uint32(N * N)
                four += two[2:]
                total += np.bincount(four, minlength=N**4)
            last = s[-3:]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    return docs.select(text_bytes(text_col).alias("b")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """log10 P(symbol | three before), interpolated with the lower orders; its size is fixed."""
    rows = counts.toArrow()
    n4 = np.zeros(N**4)
    n4[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    n4 = n4.reshape(N, N, N, N)
    p = np.full(N, 1 / N)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = n4.sum(axis=axes) if axes else n4
        p = (n + 5 * p) / (n.sum(-1, keepdims=True) + 5)
    return np.log10(p).astype(np.float32)


def with_lexicon(model: np.ndarray, words: list[str], share: float = 0.5) -> np.ndarray:
    """The character model mixed with one of a list of words, so that the decoder knows the words that matter, too."""
    n4 = np.zeros(N**4)
    for w in words:
        codes = [0, 0, 0, *filter(None, map(_char, w)), 0]
        for a, b, c, d in zip(codes, codes[1:], codes[2:], codes[3:]):
            n4[((a * N + b) * N + c) * N + d] += 1
    n4 = n4.reshape(N, N, N, N)
    total = n4.sum(-1, keepdims=True)
    p = 10.0**model
    return np.log10(np.where(total > 0, (1 - share) * p + share * (n4 + 0.5 * p) / (total + 0.5), (1 - share) * p)).astype(np.float32)


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """For each place of a text, what may stand there and the cost."""
    out, i = [], 0
    while i < len(text):
        c, j = text[i], i
        while j < len(text) and text[j] == c:
            j += 1
        if c.isalpha():
            out.append([(c, SHORTEN), (c + c, 0.0)] if j - i > 2 else [(text[i:j], 0.0)])
        elif c in LEET:
            same = [(x, SUBSTITUTE) for x in LEET[c]] + [(" ", LITERAL)]
            out.append(same)
            if j - i == 2:
                out.append(same)
            elif j - i > 2:
                out[-1] = same + [(x + x, SUBSTITUTE) for x in LEET[c]]
        elif c in FILLERS:
            out.append([("", DROP), (" ", PART)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


def viterbi(text: str, model: np.ndarray) -> str:
    """The best path through the lattice of a text in lower case."""
    states = {(0, 0, 0): (0.0, None)}
    for place in [*lattice(text), [(" ", 0.0)]]:
        new: dict = {}
        for (a, b, c), (score, back) in states.items():
            for piece, cost in place:
                x, y, z, s = a, b, c, score + cost
                for ch in piece:
                    d = _char(ch)
                    if d or z:
                        s += float(model[x, y, z, d])
                        x, y, z = y, z, d
                if (x, y, z) not in new or new[x, y, z][0] < s:
                    new[x, y, z] = (s, (back, piece))
        states = new
    _, back = max(states.values(), key=lambda v: v[0])
    parts = []
    while back:
        back, piece = back
        parts.append(piece)
    return " ".join("".join(reversed(parts)).split())


class Restorer:
    """Restored words of tokens; what it has decoded it keeps, up to a bounded number."""

    def __init__(self, model: np.ndarray, keep: int = 200_000):
        self.model, self.keep, self.known = model, keep, {}

    def words(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            found = self._words(token)
            if len(self.known) < self.keep:
                self.known[token] = found
        return found

    def _words(self, token: str) -> tuple[str, ...]:
        core = token.strip(_EDGE)
        if not _MARK.search(core) or _HEX.fullmatch(core) or _NUMBER.fullmatch(core) or not _spells(core):
            bare = core.strip("!$+|@")
            return (bare,) if bare else ()
        core = _RUN.sub(r"\1\1\1", core)  # the lattice takes longer runs alike
        # signs at the end may be punctuation; the reading without them is tried as well
        return tuple(sorted({w for x in {core, core.rstrip("!$+|")} for w in self._decoded(x)}))

    def _decoded(self, text: str, size: int = 4000, overlap: int = 40) -> list[str]:
        """The words of the best path, of long texts in pieces that overlap."""
        return [w for at in range(0, len(text), size) for w in viterbi(text[max(0, at - overlap) : at + size], self.model).split()]

    def document(self, text: str) -> set[str]:
        """The distinct restored words of a whole text."""
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            out.update(self.words(token))
        for m in _APART.finditer(low):
            if _spells(m[0]):
                out.update(self._decoded(re.sub(" +", " ", m[0])))
        return out

    def text(self, text: str) -> str:
        """A text with every token restored."""
        low = _APART.sub(lambda m: viterbi(re.sub(" +", " ", m[0]), self.model) if _spells(m[0]) else m[0], text.lower())
        return " ".join(" ".join(self.words(t)) for t in low.split())


def features(word: str) -> tuple[str, ...]:
    """A word, and its beginnings of four and five letters."""
    return (word, *(f"{word[:n]}~" for n in (4, 5) if len(word) > n))


def restore(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored): whole texts in lower case with disguised words restored; null is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(character_model(count_characters(docs, text_col)))

    def run(batches):
        r = Restorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.text(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "restored"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, docs.select(F.col(id_col).alias("doc_id")).schema.simpleString()[7:-1].replace(":", " ") + ", restored string")


def _count_features(sent, keep: int = 400_000):
    """(feature, toxic, clean): for each task, in how many texts of each label a feature stands."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def out(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], schema=schema)

    def run(batches):
        r, n = Restorer(sent.value), defaultdict(lambda: [0, 0])
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in {f for w in r.document(text) for f in features(w)}:
                    n[f][0 if y else 1] += 1
                if len(n) > keep:
                    yield out(n)
                    n.clear()
        yield out(n)

    return run


class Finder:
    """The model's features that stand in texts: each distinct token of a piece of a batch is restored once."""

    def __init__(self, model: np.ndarray, number: dict[str, int], keep: int = 200_000):
        self.restorer, self.number, self.keep, self.known = Restorer(model, 0), number, keep, {}

    def _of(self, words) -> tuple[int, ...]:
        return tuple({self.number[f] for w in words for f in features(w) if f in self.number})

    def _token(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            found = self._of(self.restorer.words(token))
            if len(self.known) < self.keep:
                self.known[token] = found
        return found

    def find(self, texts: list[str], size: int = 1 << 23):
        """(text, feature): the distinct pairs, of about ``size`` characters at a time."""
        held, first, n = [], 0, 0
        for i, t in enumerate(texts):
            held.append(t.lower())
            n += len(t)
            if n >= size or i + 1 == len(texts):
                doc, feature = self._piece(held)
                yield doc + first, feature
                held, first, n = [], i + 1, 0

    def _piece(self, low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.utf8_split_whitespace(pa.array(low, pa.string()))
        values, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        coded = values.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        found = [self._token(t) if t else () for t in coded.dictionary.to_pylist()]
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((f for x in found for f in x), np.int64, int(length.sum()))
        begin = np.cumsum(length) - length
        some = np.flatnonzero(length[at] > 0)
        n = length[at[some]]
        pairs = np.repeat(doc[some], n), flat[np.repeat(begin[at[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # letters apart can only be where three tokens in a row have one character
        single = pc.equal(pc.utf8_length(coded.dictionary), 1).to_numpy(zero_copy_only=False)[at]
        apart = []
        for i in np.unique(doc[:-2][single[:-2] & single[1:-1] & single[2:]]).tolist() if len(single) > 2 else ():
            apart += [(i, f) for m in _APART.finditer(low[i]) if _spells(m[0]) for f in self._of(self.restorer._decoded(re.sub(" +", " ", m[0])))]
        more = np.array(apart, np.int64).reshape(-1, 2)
        both = np.unique(np.concatenate([pairs[0] * (len(self.number) + 1) + pairs[1], more[:, 0] * (len(self.number) + 1) + more[:, 1]]))
        return both // (len(self.number) + 1), both % (len(self.number) + 1)


def _known_features(sent):
    """(y, found): the model's features that stand in each text."""

    def run(batches):
        finder = Finder(sent.value["model"], sent.value["number"])
        for b in batches:
            found: list[list[int]] = [[] for _ in range(b.num_rows)]
            for doc, feature in finder.find(b.column(0).to_pylist()):
                for i, f in zip(doc.tolist(), feature.tolist()):
                    found[i].append(f)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    return run


def fit_logistic(found: list[list[int]], y: np.ndarray, weight: np.ndarray, n: int, rounds: int = 1500, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights of at least zero and an intercept, by projected gradient steps with momentum."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.array([j for f in found for j in f], int)
    weight = weight / weight.sum()
    prior = float((weight * y).sum())
    w, b = np.zeros(n), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    mw, vw, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(found))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw, gb = np.bincount(col, g[row], n) + ridge * w, float(g.sum())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = np.maximum(0, w - 0.05 * fix * mw / (np.sqrt(vw) + 1e-9))
        b -= 0.05 * fix * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def _near_copy_keys(shingle: int = 3, minima: int = 4):
    """(id, y, b, sketch): the least hashes of a text's word shingles under several functions; of a text with fewer words the hash of them all."""

    def sketch(raw: bytes) -> bytes:
        h = shingle_hashes(raw, shingle)
        if not len(h):
            return xxhash.xxh64_digest(b" ".join(raw.translate(LOWER).split()))
        return np.array([mixed(h, seed).min() for seed in SEEDS[:minima]]).tobytes()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(raw.as_py()) for raw in b.column(2)], pa.binary())], ["id", "y", "b", "sketch"])

    return run


def training_texts(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, id_col: str, text_col: str) -> DataFrame:
    """(id, y, b): a bounded sample of the labelled rows with their texts, in the order of a hash; of near copies, which share all their least shingle hashes, one.

    Equal texts are one before the draw.  Twice the bound is drawn and near copies are looked for in that.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    b = text_bytes(text_col)
    once = docs.select(F.col(id_col).alias("id"), F.xxhash64(b).alias("h"), F.length(b).alias("n")).join(y, "id").groupBy("h", "n", "y").agg(F.min("id").alias("id"))
    draw = lambda rows, k, n: rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(n)
    both = lambda rows, times: draw(rows, 1, times * most_toxic).unionByName(draw(rows, 0, times * most_clean))
    # the draw's size is a parameter, so it may be broadcast
    drawn = F.broadcast(checkpointed(both(once, 2).select("id", "y")))
    texts = docs.select(F.col(id_col).alias("id"), b.alias("b")).join(drawn, "id").groupBy("id", "y").agg(F.min("b").alias("b"))
    kind = texts.schema["id"].dataType.simpleString()
    keyed = checkpointed(texts.mapInArrow(_near_copy_keys(), f"id {kind}, y int, b binary, sketch binary"))
    kept = both(keyed.groupBy("sketch", "y").agg(F.min("id").alias("id")), 1).select("id", "y").distinct()
    return keyed.select("id", "y", "b").join(F.broadcast(kept), ["id", "y"])


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, id_col: str, text_col: str) -> DataFrame:
    """(id, y) of :func:`training_texts`."""
    return training_texts(docs, labels, most_toxic, most_clean, id_col, text_col).select("id", "y")


def score_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 6000, most_clean: int = 10_000, most_features: int = 20_000, least: float = 2.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a column ``score`` from 0 to 1, higher for toxic texts, from the text alone.

    ``labels`` has doc_id and toxic (0 or 1); rows without either are left out, the largest label of an id counts.  At
    most ``most_toxic`` and ``most_clean`` labelled rows are fitted on, and the model has at most ``most_features``
    features, each at least ``least`` standard errors likelier in toxic texts; the decoder's character model is then mixed
    with one of those features.  Null and empty texts are scored as texts
    without words.  Without labels of both kinds every score is 0 (no toxic ones) or 1 (no clean ones).  Rows are
    returned as often as given, with all their columns; a column called score is replaced.
    """
    context = docs.sparkSession.sparkContext
    model = character_model(count_characters(docs, text_col))
    sample = checkpointed(training_texts(docs, labels, most_toxic, most_clean, id_col, text_col).select(F.col("b").cast("string").alias("t"), "y"))
    have = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        return docs.withColumn("score", F.lit(1.0 if toxic else 0.0))
    texts = sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = context.broadcast(model)
    counted = texts.mapInArrow(_count_features(sent), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    z = (F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    names = [r["feature"] for r in counted.where("a >= 3").withColumn("z", z).where(F.col("z") >= least).orderBy(F.desc("z"), "feature").limit(most_features).select("feature").collect()]
    number = {f: i for i, f in enumerate(names)}
    model = with_lexicon(model, [f.rstrip("~") for f in names])
    known = context.broadcast({"model": model, "number": number})
    rows = texts.mapInArrow(_known_features(known), "y int, found array<int>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    w, b = fit_logistic(rows.column("found").to_pylist(), y, np.ones(len(y)), len(names))
    weights = context.broadcast({"model": model, "number": number, "w": w, "b": b})
    scored = docs.withColumn("score", F.lit(0.0))
    at, where = scored.columns.index("score"), docs.columns.index(text_col)

    def run(batches):
        m = weights.value
        finder = Finder(m["model"], m["number"])
        for batch in batches:
            z = np.full(batch.num_rows, m["b"])
            for doc, feature in finder.find([t or "" for t in batch.column(where).to_pylist()]):
                z += np.bincount(doc, m["w"][feature], batch.num_rows)
            yield batch.set_column(at, batch.schema.field(at), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64()))

    return scored.mapInArrow(run, scored.schema)


def rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns stay."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_toxicity(packed, labels, **how).where("score < 0.5").select("row.*")
