"""Operator 7: language identification by character language models.

One interpolated Kneser-Ney model of order 4 per language. Texts become
letters in lower case with one blank between words; four letters of 16 bits
are an exact 64-bit key. Spark counts the 4-grams of each language over all
training texts. Lower orders need no further pass: Kneser-Ney takes them from
the distinct 4-grams (how many letters precede an n-gram). Every counted
4-gram is in its model. Models of up to ``at_once`` 4-grams in all are kept as
sorted arrays of scrambled keys with discounted probabilities and back-off
weights, sent to every task. Larger ones stay tables: the 4-grams of all texts
meet them in joins, and each run of texts of a few MB gets the bits of its own
4-grams. Both ways give the same figures.

A text goes to the language with the lowest cross-entropy per letter. It is
rejected when even that is too high for the language: over the entropy of the
language's own training text by ``min_excess`` bits and by ``z`` standard
errors, both measured from the training counts. ``z`` is large because letters
come in bursts: one random key of twenty letters must not reject a short text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm._tokens import U64, mix64, slices, small_batches
from bazaar.session import reliable_checkpoint

ORDER = 4
_BITS = U64(16)


def letter_codes() -> np.ndarray:
    """Code of each character of the basic plane: its lower-case letter, 0 for no letter."""
    out = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) & 0xFFFF if len(low) == 1 else c
    return out


def text_grams(codes: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """Packed 4-grams of each text (blank before the first word, one blank after
    every word), their offsets by text, and whether a text has a letter."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]  # characters before each text
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n_texts = len(offs) - 1
    if not len(cp) or len(cp) != starts[-1]:
        if len(cp):  # invalid UTF-8: text by text
            parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                     for a, b in zip(offs[:-1], offs[1:], strict=True)]
            cp, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        else:
            return np.zeros(0, U64), np.zeros(n_texts + 1, np.int64), np.zeros(n_texts, bool)
    x = np.where(cp < 0x10000, codes[np.minimum(cp, 0xFFFF)], 0).astype(np.uint16)
    far = np.flatnonzero(cp >= 0x10000)
    for i in far:
        if chr(cp[i]).isalpha():
            x[i] = (ord(chr(cp[i]).lower()) & 0xFFFF) or 1
    # a blank ends every text: put one in after it, then merge runs of blanks
    x = np.insert(x, starts[1:], 0)
    at = starts + np.arange(n_texts + 1)
    first = np.zeros(len(x), bool)
    first[at[:-1]] = True
    keep = x != 0
    keep[1:] |= (x[:-1] != 0) & ~first[1:]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    x = x[keep].astype(U64)
    key = x.copy()
    for k in range(1, ORDER):
        back = np.zeros(len(x), U64)
        np.left_shift(x[:-k], _BITS * U64(k), out=back[k:])
        for j in range(k):  # the first k letters of a text have no letter k places back
            back[np.minimum(at[:-1] + j, at[1:] - 1)[at[:-1] < at[1:]]] = 0
        key |= back
    return key, at, np.diff(at) > 0


def _count(flush: int = 200_000):
    """(lang, gram, n) rows of labelled texts, merged inside the task while they fit."""
    def merged(parts):
        return pa.concat_tables(parts).group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns(
            ["lang", "gram", "n"])

    def run(batches):
        codes, parts, held = letter_codes(), [], 0
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lo, hi, data, offs in slices(b.column("text")):
                key, at, _ = text_grams(codes, data, offs)
                names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                row = np.repeat(which, np.diff(at))
                for i, name in enumerate(names):
                    v = pc.value_counts(pa.array(key[row == i].view(np.int64)))
                    t = pa.table({"lang": pa.array([name] * len(v), pa.string()), "gram": v.field("values"),
                                  "n": v.field("counts")})
                    parts.append(t)
                    held += len(v)
                if held > flush:
                    parts = [merged(parts)]
                    held = parts[0].num_rows
                    if held > flush:
                        yield from parts[0].to_batches()
                        parts, held = [], 0
        if parts:
            yield from merged(parts).to_batches()
    return run


class Model:
    """Interpolated Kneser-Ney probabilities of one language."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        keys, n = grams.astype(U64), counts.astype(np.float64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        self.levels = []  # from order 4 down: sorted hashes, discounted probability; contexts, back-off weight
        for k in range(ORDER, 0, -1):
            ctx = keys >> _BITS
            cut = np.concatenate([[True], ctx[1:] != ctx[:-1]])
            at = np.flatnonzero(cut)
            total = np.add.reduceat(n, at)
            types = np.diff(np.append(at, len(keys)))
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9)) if n1 and n2 else 0.5
            prob = np.maximum(n - d, 0) / np.repeat(total, types)
            self.levels.append((*self._sorted(keys, prob), *self._sorted(ctx[at], d * types / total)))
            if k > 1:  # how many letters precede each shorter n-gram
                keys, n = np.unique(keys & U64((1 << 16 * (k - 1)) - 1), return_counts=True)
                n = n.astype(np.float64)
        self.floor = 1.0 / max(2, len(keys) + 1)
        p = self.probability(grams.astype(U64))
        bits = -np.log2(p)
        self.mean = float((bits * counts).sum() / counts.sum())
        self.sd = float(np.sqrt(((bits - self.mean) ** 2 * counts).sum() / counts.sum()))

    @staticmethod
    def _sorted(keys, values):
        h = mix64(keys)
        order = np.argsort(h)
        return h[order], values[order]

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.floor / 2)
        for k, (keys, prob, ctxs, back) in zip(range(1, ORDER + 1), reversed(self.levels)):
            part = grams & U64((1 << 16 * k) - 1) if k < ORDER else grams
            p = self._look(ctxs, back, mix64(part >> _BITS), 1.0) * p + self._look(keys, prob, mix64(part), 0.0)
        return p

    @staticmethod
    def _look(keys, values, want, none):
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[i] == want, values[i], none)


def _judge(names: list[str], mean: np.ndarray, sd: np.ndarray, z: float, min_excess: float, cap: int, look):
    """Judges a batch (id, held_out, text); ``look`` gives the bits of 4-grams, a row per language."""
    codes = letter_codes()

    def run(b):
        for lo, hi, data, offs in slices(b.column("text")):
            key, at, some = text_grams(codes, data, offs)
            pred, score, entropy = np.full(hi - lo, "und", object), np.zeros(hi - lo), np.full(hi - lo, np.nan)
            rejected = np.ones(hi - lo, bool)
            if some.any() and names:
                enc = pc.dictionary_encode(pa.array(key.view(np.int64)))
                bits = look(enc.dictionary.to_numpy().view(U64))
                n = np.diff(at)[some]
                idx = enc.indices.to_numpy(zero_copy_only=False)
                h = np.stack([np.add.reduceat(bits[m][idx], at[:-1][some]) / n for m in range(len(names))])
                best = h.argmin(axis=0)
                low = h.min(axis=0)
                share = np.exp2(-(h - low) * np.minimum(n, cap))
                pred[some], score[some] = np.array(names, object)[best], 1 / share.sum(axis=0)
                entropy[some] = low
                rejected[some] = (low - mean[best] > min_excess) & (low - mean[best] > z * sd[best] / np.sqrt(n))
            whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                     for c in (b.column("id"), b.column("held_out"))]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(lo, hi - lo) for c in whole),
                 pa.array(pred, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)],
                ["id", "held_out", "lang_pred", "score", "entropy", "rejected"])
    return run


def _score(models: dict[str, Model], few: set[str], z: float, min_excess: float, cap: int):
    names = list(models)
    mean = np.array([models[m].mean for m in names])
    sd = np.array([np.inf if m in few else models[m].sd for m in names])

    def run(batches):
        known, bits = np.zeros(0, U64), np.zeros((len(names), 0))

        def look(u):
            nonlocal known, bits
            if len(known) > 300_000:
                known, bits = np.zeros(0, U64), np.zeros((len(names), 0))
            if len(known):
                new = u[known[np.minimum(np.searchsorted(known, u), len(known) - 1)] != u]
            else:
                new = u
            if len(new):
                more = np.stack([-np.log2(models[m].probability(new)) for m in names])
                known, bits = np.concatenate([known, new]), np.concatenate([bits, more], axis=1)
                order = np.argsort(known)
                known, bits = known[order], bits[:, order]
            return bits[:, np.searchsorted(known, u)]

        judge = _judge(names, mean, sd, z, min_excess, cap, look)
        for b in batches:
            yield from judge(b)
    return run


def _low(key: Column, k: int) -> Column:
    """The last k letters of a 4-gram."""
    return key if k == ORDER else key.bitwiseAND(F.lit((1 << 16 * k) - 1))


def _levels(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """What ``Model`` holds, as tables, from order 1 up: (lang, key, prob) and (lang, ctx, back);
    order 1 has the language's floor beside back."""
    cur = grams.select("lang", F.col("gram").alias("key"), F.col("n").cast("double").alias("n"))
    out = []
    for k in range(ORDER, 0, -1):
        n1, n2 = (F.sum((F.col("n") == i).cast("double")) for i in (1, 2))
        d = cur.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), F.count(F.lit(1)).alias("every")).select(
            "lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.greatest(F.lit(.1), F.least(
                F.lit(.9), F.col("n1") / (F.col("n1") + 2 * F.greatest("n2", F.lit(1.0)))))).otherwise(.5).alias("d"),
            (1 / F.greatest(F.lit(2), F.col("every") + 1)).alias("floor"))
        ctx = F.shiftrightunsigned("key", 16)
        held = cur.withColumn("ctx", ctx).groupBy("lang", "ctx").agg(F.sum("n").alias("total"),
                                                                     F.count(F.lit(1)).alias("types"))
        held = reliable_checkpoint(held.join(F.broadcast(d), "lang"))  # one row per language
        prob = (cur.withColumn("ctx", ctx).join(held, ["lang", "ctx"])
                .select("lang", "key", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("prob")))
        back = held.select("lang", "ctx", (F.col("d") * F.col("types") / F.col("total")).alias("back"),
                           *(["floor"] if k == 1 else []))
        out.append((reliable_checkpoint(prob), back))
        if k > 1:
            cur = reliable_checkpoint(cur.groupBy("lang", _low(F.col("key"), k - 1).alias("key")).agg(
                F.count(F.lit(1)).cast("double").alias("n")))
    return out[::-1]


def _bits(want: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, gram, bits) of (lang, gram), as ``Model.probability`` has them."""
    out = want
    for k, (prob, back) in enumerate(levels, 1):
        part = _low(F.col("gram"), k)
        out = out.withColumns({"key": part, "ctx": F.shiftrightunsigned(part, 16)})
        # order 1 has the empty context alone: one row per language
        out = out.join(F.broadcast(back) if k == 1 else back, ["lang", "ctx"], "left").join(prob, ["lang", "key"], "left")
        if k == 1:
            out = out.withColumn("p", F.col("floor") / 2).drop("floor")
        out = out.select("lang", "gram", (F.coalesce("back", F.lit(1.0)) * F.col("p")
                                          + F.coalesce("prob", F.lit(0.0))).alias("p"))
    return out.select("lang", "gram", (-F.log2("p")).alias("bits"))


def _runs(max_bytes: int):
    """Rows with a number for each run of consecutive texts of about ``max_bytes``."""
    def run(batches):
        at, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            n = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            ends = held + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(at + ends // max_bytes), *b.columns], ["run", *b.schema.names])
            held = int(ends[-1]) if len(ends) else held
    return run


def _run_grams(batches):
    """Distinct (run, gram), once per batch."""
    codes = letter_codes()
    for b in batches:
        runs = b.column("run").to_numpy()
        for lo, hi, data, offs in slices(b.column("text")):
            key, at, _ = text_grams(codes, data, offs)
            row = np.repeat(runs[lo:hi], np.diff(at))
            for r in np.unique(row):
                u = np.unique(key[row == r]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), r)), pa.array(u)], ["run", "gram"])


def _by_joins(src: DataFrame, grams: DataFrame, names: list[str], few: set[str], z: float, min_excess: float, cap: int,
              max_bytes: int = 8 << 20) -> DataFrame:
    """Judged texts where the models are too large for a task."""
    kind = src.schema["id"].dataType.simpleString()
    told = reliable_checkpoint(src.mapInArrow(
        _runs(max_bytes), f"run bigint, id {kind}, held_out boolean, text string"))
    held = reliable_checkpoint(told.select("run", "text").mapInArrow(_run_grams, "run bigint, gram bigint").distinct())
    langs = src.sparkSession.createDataFrame([(n,) for n in names], "lang string")
    want = held.select("gram").distinct().crossJoin(F.broadcast(langs))
    bits = reliable_checkpoint(_bits(want, _levels(grams)))
    seen = grams.join(bits, ["lang", "gram"])  # texts to learn from are among the texts
    mean = seen.groupBy("lang").agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("mean"))
    off = (F.col("bits") - F.col("mean")) * (F.col("bits") - F.col("mean"))
    spread = {r.lang: r for r in seen.join(F.broadcast(mean), "lang").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum(off * F.col("n")) / F.sum("n")).alias("sd")).collect()}
    means = np.array([spread[n]["mean"] for n in names])
    sds = np.array([np.inf if n in few else spread[n]["sd"] for n in names])
    row = bits.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("lang", "bits"))).getField("bits").alias("bits"))
    sent = held.join(row, "gram").select("run", "gram", "bits")

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("gram").to_numpy().view(U64)
        order = np.argsort(known)
        bits = right.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, len(names))[order].T
        known = known[order]
        judge = _judge(names, means, sds, z, min_excess, cap, lambda u: bits[:, np.searchsorted(known, u)])
        return pa.Table.from_batches(list(judge(left)))

    return told.groupBy("run").cogroup(sent.groupBy("run")).applyInArrow(judged, _schema(kind))


def _schema(kind: str) -> str:
    return f"id {kind}, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def held_out(id_col: str) -> Column:
    """crc32 of the id as text modulo 5 is 0 (NULL id: neither held out nor learned from)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): every 4-gram of the documents that are not held out."""
    some = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    some = some.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    grams = some.mapInArrow(_count(), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    return reliable_checkpoint(grams)


def train(grams: DataFrame, names: list[str]) -> dict[str, Model]:
    """One model per language of the counted 4-grams."""
    models = {}
    for lang in names:
        t = grams.where(F.col("lang") == lang).select("gram", "n").toArrow()
        models[lang] = Model(t.column("gram").to_numpy(), t.column("n").to_numpy())
    return models


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      at_once: int = 2_000_000, z: float = 12.0, min_excess: float = 1.0,
                      cap: int = 32, least_letters: int = 5_000) -> DataFrame:
    """-> (doc_id, held_out, lang_pred, score, entropy, rejected), one row per input row.

    ``lang_pred`` is the language of lowest cross-entropy, `und` if the text
    is NULL or has no letter. ``score`` is that language's share among all, at
    equal priors, of the likelihood of the text counted as at most ``cap``
    letters. ``rejected`` texts read like none of the languages (see the
    module text), or are `und`. A language learned from fewer than
    ``least_letters`` letters says too little about texts it has not seen: a
    text that is nearest to it is not rejected.

    Defined cases: labels equal to '' or any other text are languages of their
    own; NULL labels are not learned from. Rows that repeat an id are separate
    texts. A NULL id is neither held out nor learned from. With no training
    text everything is `und` with score 0. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    grams = counted(docs, id_col, text_col, lang_col)
    told = grams.groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).collect()
    types = {r.lang: r.types for r in told}  # one row per language
    names, few = sorted(types), {r.lang for r in told if r.n < least_letters}
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    if sum(types.values()) > at_once:
        out = _by_joins(src, grams, names, few, z, min_excess, cap)
    else:
        kind = src.schema["id"].dataType.simpleString()
        out = src.mapInArrow(_score(train(grams, names), few, z, min_excess, cap), _schema(kind))
    return out.withColumnRenamed("id", "doc_id")
