"""An interpolated modified Kneser-Ney trigram model over hashed words.

Spark counts; the counts stand in shards of sorted hash arrays in the shared
folder, which workers map into memory to score texts.

Triples seen less often than ``least`` are not stored.  With 2, the default,
words after two others that were seen once only are left out, as no text but
their own has them; their weight goes to the shorter context, and their number,
which the discounts need, is what the stored ones leave of all.  A second pass
then emits only those whose two pairs both occur twice at least.  With 1 all are
stored.

Shards follow a hash of the context, so a context's sums are whole where its
pairs are.  Contexts with more words than a shard is meant for, or more than a
thousandth of all, would overfill it: their pairs go by a hash of both words,
and their sums are added up afterwards.  There are at most as many of them as
shards, or a thousand, and no more than frequent words.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix, portions, powers
from tidemark.llm.shared import cut, scratch_path, ship

#: Training tokens per shard, about; share of a hot context; bytes of text hashed together; tokens scored or counted together.
SHARD_TOKENS, HOT_PART, STRIP, TOGETHER = 1 << 21, 1024, 1 << 22, 1 << 22
#: Files that a worker maps at once; those longest unused are let go.
MAPPED = 8192
#: Bits of a following word's hash that a pair keeps.
WORD_BITS = 48

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the runs of bytes that aren't ASCII white space: a polynomial over random byte values."""
    if "value" not in _tables:
        value = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
        value[[32, *range(9, 14)]] = 0
        _tables["value"] = value
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + STRIP)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":  # a strip ends between words
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        value = _tables["value"][part]
        edge = np.diff(np.r_[False, value != 0, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(part)])])
        found.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


#: A byte that no text has stands for the end of a document.
END = hash_words(b"\xff")[0]
START = mix(np.array([1], np.uint64))[0]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of contexts and words of all texts, each with an end token; null texts are empty."""
    words = hash_words(b"".join((t or "").encode("utf-8", "surrogatepass") + b" \xff " for t in texts).lower())
    contexts = np.r_[START, words[:-1]] if len(words) else words
    contexts[1:][words[:-1] == END] = START
    return contexts, words


def _pair(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(contexts * _U(3) + (words & _U((1 << WORD_BITS) - 1)) * _U(_ODD))


def _triple(before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Hash of three words, from those of its first two and last two."""
    return mix(before * _U(5) + pairs * _U(_ODD))


def _put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays one after the other, each on a multiple of 8 bytes, with their places in front; then move to the name."""
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    own = f"{top}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(own) as out:
        head = ",".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode()
        out.write(np.array([len(head)], "<u8").tobytes() + head + b"\0" * (-len(head) % 8))
        for a in arrays.values():
            data = np.ascontiguousarray(a).tobytes()
            out.write(data + b"\0" * (-len(data) % 8))
    store.move(own, f"{top}/{name}")


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; {} if there is none.  A file of a remote store is copied first, its name is removed once it is mapped."""
    store, top = fs.FileSystem.from_uri(folder)
    path, local = f"{top}/{name}", isinstance(store, fs.LocalFileSystem)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    if not local:
        with store.open_input_stream(path) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
            shutil.copyfileobj(source, copy)
        path = copy.name
    whole = np.memmap(path, np.uint8, "r")
    if not local:
        os.unlink(path)
    size = int(whole[:8].view("<u8")[0])
    at, out = 8 + size + -size % 8, {}
    for entry in bytes(whole[8 : 8 + size]).decode().split(","):
        key, kind, n = entry.split(":")
        out[key] = whole[at : at + int(n) * np.dtype(kind).itemsize].view(kind)
        at += out[key].nbytes + -out[key].nbytes % 8
    return out


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, those over 254 apart."""
    large = np.flatnonzero(counts > 254)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "large_at": large.astype("<u4"), "large": counts[large].astype("<u8")}


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of a file fit, else in 64."""
    return x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8")


def _sums(sums: np.ndarray) -> dict[str, np.ndarray]:
    return {k: _narrow(x) for k, x in zip(("total", "once", "twice", "more"), sums, strict=True)}


def _counts(file: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    out = file["count"][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = file["large"][np.searchsorted(file["large_at"], at[large])]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted (sorted) are in keys (sorted), and where."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)), at


@dataclass
class Model:
    """Where the arrays are, and the few numbers that are the same for all: workers get this object, not the counts."""

    folder: str
    shards: int
    word_shards: int
    documents: int
    train_tokens: int
    types: int
    pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float
    hot: np.ndarray
    hot_sums: np.ndarray
    hot_kinds: np.ndarray = field(default_factory=lambda: np.zeros((4, 0), np.int64))
    triple_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    order: int = 2
    files: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def _file(self, name: str) -> dict[str, np.ndarray]:
        found = self.files.pop(name, None)
        self.files[name] = _mapped(self.folder, name) if found is None else found
        while len(self.files) > MAPPED:
            self.files.pop(next(iter(self.files)))
        return self.files[name]

    def _each(self, kind: str, shard: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, int]]:
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part) and (file := self._file(f"{kind}-{shard[part[0]]:06d}")):
                yield file, part, int(shard[part[0]])

    def home(self, contexts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The shard of each pair: that of its context, of the pair itself where the context is hot."""
        return (np.where(_find(self.hot, contexts)[0], pairs, contexts) % _U(max(1, self.shards))).astype(np.int64)

    def word_sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted words: count; followers by what they count for in pairs (all, once, twice, more often); kinds of words before it."""
        count, before, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros((4, len(words)), np.int64)
        is_hot, at = _find(self.hot, words)
        count[is_hot] = self.hot_sums[0, at[is_hot]]
        out[:, is_hot] = (self.hot_kinds if self.order > 2 else self.hot_sums)[:, at[is_hot]]
        cold = np.flatnonzero(~is_hot)
        for file, part, shard in self._each("pairs", (words[cold] % _U(max(1, self.shards))).astype(np.int64)):
            known, at = _find(file["context"], words[cold[part]])
            count[cold[part[known]]] = file["total"][at[known]]
            sums = self._file(f"kinds-{shard:06d}") if self.order > 2 else file
            for i, name in enumerate(("total", "once", "twice", "more")):
                out[i, cold[part[known]]] = sums[name][at[known]]
        short = words & _U((1 << WORD_BITS) - 1)
        for file, part, _ in self._each("words", (short % _U(max(1, self.word_shards))).astype(np.int64)):
            known, at = _find(file["word"], short[part])
            before[part[known]] = file["before"][at[known]]
        count[words == END] = self.documents
        return count, out, before

    def pair_counts(self, contexts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and how many kinds of words stand before each, which is what it counts for below triples."""
        out, kinds = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for file, part, shard in self._each("pairs", self.home(contexts, pairs)):
            known, at = _find(file["pair"], pairs[part])
            out[part[known]] = _counts(file, at[known])
            kinds[part[known]] = _counts(self._file(f"kinds-{shard:06d}"), at[known]) if self.order > 2 else out[part[known]]
        return out, kinds

    def triple_counts(self, homes: np.ndarray, triples: np.ndarray) -> np.ndarray:
        out = np.zeros(len(triples), np.int64)
        for file, part, _ in self._each("triples", homes):
            known, at = _find(file["triple"], triples[part])
            out[part[known]] = _counts(file, at[known])
        return out

    def kept(self, pairs: np.ndarray) -> np.ndarray:
        """What the stored words after each pair weigh, discounts taken off."""
        out = np.zeros(len(pairs))
        one, two, more = self.triple_discounts
        for file, part, _ in self._each("after", (pairs % _U(max(1, self.shards))).astype(np.int64)):
            known, at = _find(file["pair"], pairs[part])
            at = at[known]
            out[part[known]] = file["total"][at] - (one * file["once"][at] if "once" in file else 0) - two * file["twice"][at] - more * file["more"][at]
        return out

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        contexts, words = tokens(texts)
        every = np.unique(np.r_[words, contexts])
        total, sums, before = self.word_sums(every)
        word, context = np.searchsorted(every, words), np.searchsorted(every, contexts)
        base = np.log10((total + 1) / (self.train_tokens + self.types + 1))
        one = (np.maximum(before - _discount(before, self.word_discounts), 0) + self.word_left / (self.types + 1)) / max(1, self.pairs) if self.pairs else np.full(len(every), 1 / (self.types + 1))
        hashes = _pair(contexts, words)
        pairs, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        count, kinds = self.pair_counts(contexts[first], pairs)
        c, w = context[first], word[first]
        left = self.discounts[0] * sums[1, c] + self.discounts[1] * sums[2, c] + self.discounts[2] * sums[3, c]
        seen = sums[0, c] > 0
        p = np.where(seen, (np.maximum(kinds - _discount(kinds, self.discounts), 0) + left * one[w]) / np.maximum(sums[0, c], 1), one[w])[back]
        if self.order > 2:
            at = np.flatnonzero(contexts != START)  # these have two words before them
            at = at[count[back[at - 1]] > 0]
            triples, some, of = np.unique(_triple(hashes[at - 1], hashes[at]), return_index=True, return_inverse=True)
            n = self.triple_counts(self.home(contexts[at[some]], hashes[at[some]]), triples)[of]
            shorter, of = np.unique(back[at - 1], return_inverse=True)
            whole = count[shorter].astype(float)
            rest = whole - self.kept(pairs[shorter])
            p[at] = (n - _discount(n, self.triple_discounts) + rest[of] * p[at]) / whole[of]
        ends = np.flatnonzero(words == END)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return pd.DataFrame({"n_tokens": ends - starts + 1, "n_known": add((total[word] > 0).astype(np.int64)), "base_score": add(base[word]), "score": add(np.log10(p))})


def _discount(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


def estimate_discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many things were seen one to four times; plain fractions where these are too few."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.array([len(a)], "<u8").tobytes() + a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(data, "<u8", 1, at)[0])
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 7; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _survey(frames: Iterator[pd.DataFrame], part_of: int) -> Iterator[pd.DataFrame]:
    """Documents, tokens, and the words with more than a ``part_of``-th of a portion of the text."""
    for part in portions(frames, STRIP):
        _, words = tokens(list(part["text"]))
        kinds, counts = np.unique(words, return_counts=True)
        large = (counts * part_of > len(words)) & (kinds != END)
        yield pd.DataFrame({"word": np.r_[END, kinds[large]].view(np.int64), "n": np.r_[len(part), counts[large]], "tokens": np.r_[len(words), np.zeros(large.sum(), np.int64)]})


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 3, least: int = 2) -> Model:
    """Count all rows of ``docs`` and write the model of ``order`` 2 or 3 to ``folder``, which all executors must share.

    Triples are stored that occur ``least`` times at least: 1 or 2.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("text"))
    end = int(END.view(np.int64))

    def surveyed(part_of: int) -> DataFrame:
        found = texts.mapInPandas(lambda frames: _survey(frames, part_of), "word long, n long, tokens long")
        return cut(found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), "survey")

    survey = surveyed(4 * HOT_PART)
    first = survey.where(F.col("word") == end).first()
    documents, total = (int(first["n"]), int(first["tokens"])) if first else (0, 0)
    if not documents:
        return Model(folder, 0, 0, 0, 0, 0, 0, (0.5,) * 3, (0.5,) * 3, 0.0, np.zeros(0, np.uint64), np.zeros((4, 0), np.int64))
    most = min(total // HOT_PART, SHARD_TOKENS)
    if most * HOT_PART < total - HOT_PART:  # words with a smaller part of all may overfill a shard too
        survey = surveyed(4 * -(-total // most))
    hot_words = [r["word"] for r in survey.where((F.col("word") != end) & (F.col("n") > most)).select("word").collect()]  # at most HOT_PART, or as many as shards
    hot = np.unique(np.r_[np.array(hot_words, np.int64).view(np.uint64), START])
    shards = max(1, -(-total // SHARD_TOKENS))
    word_shards, higher = max(1, shards // 4), order > 2
    mask = _U((1 << WORD_BITS) - 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            contexts, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            pairs, first, n = np.unique(_pair(contexts, words), return_index=True, return_counts=True)
            contexts, words = contexts[first], words[first] & mask
            shard = (np.where(_find(hot, contexts)[0], pairs, contexts) % _U(shards)).astype(np.int64)
            order = np.lexsort((contexts, shard))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                kinds, runs = np.unique(contexts[part], return_counts=True)
                low = words[part].view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8]
                rows.append((int(shard[part[0]]), _pack(kinds, runs.astype("<u4"), np.ascontiguousarray(low).reshape(-1), n[part].astype("<u4"))))
            return pd.DataFrame(rows, columns=["shard", "data"])

        parts, size = [], 0
        for batch in portions(frames, STRIP):
            parts.append(tokens(list(batch["text"])))
            size += len(parts[-1][0])
            if size >= TOGETHER:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        """Add up a shard's pairs and write them; give on its counts of counts, hot contexts and kinds of pairs per word."""
        shard = int(frame["shard"].iloc[0])
        contexts, words, counts = [], [], []
        for data in frame["data"]:
            kinds, runs, low, n = _unpack(data, "<u8", "<u4", "u1", "<u4")
            wide = np.zeros((len(n), 8), np.uint8)
            wide[:, : WORD_BITS // 8] = low.reshape(len(n), -1)
            contexts.append(np.repeat(kinds, runs))
            words.append(wide.view("<u8").reshape(-1))
            counts.append(n)
        context, word, n = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts).astype(np.int64)
        pair = _pair(context, word)
        order = np.argsort(pair)
        heads = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
        count = np.add.reduceat(n[order], heads)
        first = order[heads]
        pair, context, word = pair[first], context[first], word[first]
        by = np.argsort(context, kind="stable")
        kinds, at = np.unique(context[by], return_index=True)
        sums = np.array([np.add.reduceat(x[by], at) for x in (count, count == 1, count == 2, count > 2)], np.int64)
        is_hot, _ = _find(hot, kinds)
        _put(folder, f"pairs-{shard:06d}", {"pair": pair} | _small(count) | {"context": kinds[~is_hot]} | _sums(sums[:, ~is_hot]))
        if higher:  # which context each pair has: cold ones in order, then hot ones
            place = np.cumsum(~is_hot) - 1
            place[is_hot] = (~is_hot).sum() + np.arange(is_hot.sum())
            _put(folder, f"contexts-{shard:06d}", {"of": place[np.searchsorted(kinds, context)].astype("<u4"), "hot": kinds[is_hot]})
        rows = [("stat", shard % word_shards, b"", [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int((~is_hot).sum()), len(count)])]
        rows += [("hot", shard % word_shards, b"", [int(k), *s]) for k, s in zip(kinds[is_hot].view(np.int64), sums[:, is_hot].T.tolist(), strict=True)]
        after, before = np.unique(word, return_counts=True)
        home = (after % _U(word_shards)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        rows += [("word", int(home[p[0]]), _pack(after[p], before[p].astype("<u4")), []) for p in np.split(order, np.flatnonzero(np.diff(home[order])) + 1)]
        return pd.DataFrame(rows, columns=["kind", "home", "data", "values"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        """Write how many kinds of words stand before each word; give on the small rows."""
        home, out = int(frame["home"].iloc[0]), frame[frame["kind"] != "word"][["kind", "values"]]
        parts = [_unpack(d, "<u8", "<u4") for d in frame["data"][frame["kind"] == "word"]]
        if parts:
            words, before = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
            kinds, back = np.unique(words, return_inverse=True)
            total = np.bincount(back, before, len(kinds)).astype(np.int64)
            _put(folder, f"words-{home:06d}", {"word": kinds, "before": _narrow(total)})
            left = pd.DataFrame({"kind": ["left"], "values": [[int((total == k).sum()) for k in (1, 2, 3, 4)] + [int((total > 2).sum())]]})
            out = pd.concat([out, left])
        return out

    counted = texts.mapInPandas(count, "shard long, data binary").repartition(shards, "shard")
    gathered = counted.groupBy("shard").applyInPandas(gather, "kind string, home long, data binary, values array<long>")
    finished = cut(gathered.repartition(word_shards, "home").groupBy("home").applyInPandas(finish, "kind string, values array<long>"), "counts")

    def added(kind: str, n: int) -> list[int]:
        row = finished.where(F.col("kind") == kind).agg(*(F.coalesce(F.sum(F.get("values", F.lit(i))), F.lit(0)) for i in range(n))).first()
        return [int(x) for x in row]

    stat, left = added("stat", 6), added("left", 5)
    sums = np.zeros((4, len(hot)), np.int64)
    value = [F.get("values", F.lit(i)) for i in range(5)]
    for r in finished.where("kind = 'hot'").groupBy(value[0].alias("h")).agg(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(value[1:]))).collect():  # a row for each hot word
        sums[:, np.searchsorted(hot, np.array([r["h"]], np.int64).view(np.uint64)[0])] = [r[f"s{i}"] for i in range(4)]
    types = stat[4] + int((sums[0] > 0).sum()) - 1 + 1  # without the start, which is no word, and with the end
    d = estimate_discounts(left[:4])
    word_left = d[0] * left[0] + d[1] * left[1] + d[2] * left[4]
    pairs_only = Model(folder, shards, word_shards, documents, total, types, stat[5], estimate_discounts(stat[:4]), d, word_left, hot, sums)
    return _with_triples(texts, pairs_only, least) if higher else pairs_only


def _with_triples(texts: DataFrame, model: Model, least: int) -> Model:
    """The model with the triples that occur ``least`` times at least, and pairs that count for the kinds of words before them."""
    spark, folder, hot = texts.sparkSession, model.folder, model.hot
    shared = spark.sparkContext.broadcast(model)  # numbers and hot words, not the counts

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two = shared.value

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            contexts, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            hashes = _pair(contexts, words)
            pairs, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            often = two.pair_counts(contexts[first], pairs)[0][back] >= least if least > 1 else np.ones(len(hashes), bool)
            at = np.flatnonzero((contexts != START) & often)
            at = at[often[at - 1]]
            triples, some, n = np.unique(_triple(hashes[at - 1], hashes[at]), return_index=True, return_counts=True)
            at = at[some]
            home = two.home(contexts[at], hashes[at])
            order = np.lexsort((hashes[at], home))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                kinds, runs = np.unique(hashes[at[part]], return_counts=True)
                rows.append((int(home[part[0]]), _pack(kinds, runs.astype("<u4"), hashes[at[part] - 1], n[part].astype("<u4"))))
            return pd.DataFrame(rows, columns=["shard", "data"])

        parts, size = [], 0
        for batch in portions(frames, STRIP):
            parts.append(tokens(list(batch["text"])))
            size += len(parts[-1][0])
            if size >= TOGETHER:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        """Write a shard's triples, and its pairs by kinds of words before them; give on counts of counts, hot contexts, and what follows each pair."""
        shard = int(frame["shard"].iloc[0])
        last, firsts, counts = [np.zeros(0, "<u8")], [np.zeros(0, "<u8")], [np.zeros(0, np.int64)]
        for data in frame["data"]:
            if len(data):
                kinds, runs, before, n = _unpack(data, "<u8", "<u4", "<u8", "<u4")
                last.append(np.repeat(kinds, runs))
                firsts.append(before)
                counts.append(n.astype(np.int64))
        pair, before, n = np.concatenate(last), np.concatenate(firsts), np.concatenate(counts)
        triple, first, back = np.unique(_triple(before, pair), return_index=True, return_inverse=True)
        n = np.bincount(back, n, len(triple)).astype(np.int64)
        stay = n >= least
        triple, pair, before, n = triple[stay], pair[first[stay]], before[first[stay]], n[stay]
        _put(folder, f"triples-{shard:06d}", {"triple": triple} | _small(n))
        stat = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int(n.sum())]
        rows = []
        after, at = np.unique(before, return_inverse=True)
        add = lambda x: np.bincount(at, x, len(after)).astype("<u8")
        sums = [add(x) for x in (n, n == 1, n == 2, n > 2)]
        home = (after % _U(model.shards)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        for p in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
            rows.append(("after", int(home[p[0]]), _pack(after[p], *(x[p] for x in sums)), []))
        # each of a triple's occurrences but one is of a kind that its pair has had before
        held = _mapped(folder, f"pairs-{shard:06d}")
        if held:
            of = _mapped(folder, f"contexts-{shard:06d}")
            kinds = _counts(held, np.arange(len(held["pair"])))
            np.subtract.at(kinds, np.searchsorted(held["pair"], pair), n - 1)
            cold = len(held["context"])
            sums = np.array([np.bincount(of["of"], x, cold + len(of["hot"])) for x in (kinds, kinds == 1, kinds == 2, kinds > 2)]).astype(np.int64)
            _put(folder, f"kinds-{shard:06d}", _small(kinds) | _sums(sums[:, :cold]))
            stat += [int((kinds == k).sum()) for k in (1, 2, 3, 4)]
            rows += [("hot", shard, b"", [int(k), *x]) for k, x in zip(of["hot"].view(np.int64), sums[:, cold:].T.tolist(), strict=True)]
        rows.append(("stat", shard, b"", (stat + [0] * 4)[:9]))
        return pd.DataFrame(rows, columns=["kind", "home", "data", "values"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        """Write what the stored words after each pair add up to; give on the small rows."""
        parts = [_unpack(d, "<u8", "<u8", "<u8", "<u8", "<u8") for d in frame["data"][frame["kind"] == "after"]]
        if parts:
            pair, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = {k: _narrow(np.bincount(back, np.concatenate([p[i] for p in parts]), len(pair)).astype(np.int64)) for i, k in enumerate(("total", "once", "twice", "more"), 1) if k != "once" or least == 1}
            _put(folder, f"after-{int(frame['home'].iloc[0]):06d}", {"pair": pair} | sums)
        return frame[frame["kind"] != "after"][["kind", "values"]]

    counted = texts.mapInPandas(count, "shard long, data binary")
    every = spark.range(model.shards).select(F.col("id").alias("shard"), F.lit(b"").alias("data"))  # so that a shard without triples is gathered too
    gathered = counted.unionByName(every).repartition(model.shards, "shard").groupBy("shard").applyInPandas(gather, "kind string, home long, data binary, values array<long>")
    finished = cut(gathered.repartition(model.shards, "home").groupBy("home").applyInPandas(finish, "kind string, values array<long>"), "counts")
    value = [F.get("values", F.lit(i)) for i in range(9)]
    stat = [int(x or 0) for x in finished.where("kind = 'stat'").agg(*(F.sum(v) for v in value)).first()]
    kinds = np.zeros((4, len(hot)), np.int64)
    for r in finished.where("kind = 'hot'").groupBy(value[0].alias("h")).agg(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(value[1:5]))).collect():  # a row for each hot word
        kinds[:, np.searchsorted(hot, np.array([r["h"]], np.int64).view(np.uint64)[0])] = [r[f"s{i}"] for i in range(4)]
    once = stat[0] if least == 1 else model.train_tokens - model.documents - stat[4]  # all but the first tokens of texts have two words before them
    return replace(model, order=3, hot_kinds=kinds, discounts=estimate_discounts(stat[5:9]), triple_discounts=estimate_discounts([once, *stat[1:4]]), files={})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all documents that aren't held out.  Null texts count
    as empty and have the end alone.  Without documents to learn from, every
    word is equally likely.  Repeated rows count and are returned each; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.where("NOT held_out"), order=order, least=least))  # numbers and hot words, not the counts

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames, STRIP):
            found = shared.value.score(list(part["text"]))
            yield pd.concat([part[["doc_id", "held_out"]].reset_index(drop=True), found], axis=1).assign(train_tokens=shared.value.train_tokens)

    order = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInPandas(lambda frames: (f[order] for f in score(frames)), kinds)
