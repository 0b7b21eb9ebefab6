"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary
(pieces of a SentencePiece model, and all single bytes as fallback).  The
probability of a word is the sum over all its segmentations, by the forward
algorithm; the probability of a text is the product over its words.  Piece
probabilities are fitted by expectation-maximisation on a bounded sample of
labelled texts, with every letter run of them, and every text is scored whole,
each distinct word once a batch.  Short runs are taken together by length; long
ones, as scripts without spaces have them, side by side, letter by letter, so
that work and memory are linear in a run's length.

Defined results: null texts and texts without a letter are ``und`` with score
0; a null id counts as held out; rows without a language are not learned from;
with nothing to learn from every text is ``und``; repeated rows and ties are
scored alike (a tie goes to the first language by name); extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import pick
from .ragged import slices, sums, utf8

#: Rows and characters of each language that the fit takes, about (the documented bounds of the sample; rows are taken whole).
FIT_ROWS, FIT_CHARACTERS = 600, 8_000_000
#: Bytes of a run up to which runs of one length are taken together; table entries of long runs that are looked up at a time.
SHORT, AT_A_TIME = 48, 1 << 20
#: Bytes of text scored at a time.
SLICE = 8 << 20
ROUNDS, SMOOTHING = 4, 0.05
#: Bytes of a word after which the forward values are rescaled.
RESCALE = 24
UNKNOWN = "und"


def held_out(id_col):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def vocabulary(model_file: str) -> list[bytes]:
    """The pieces as bytes, a word start as a space; single bytes come first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces[model.id_to_piece(i).replace("▁", " ").encode()] = None
    return list(pieces)


#: What a piece must be to occur in a letter run; others of the vocabulary never match.
IN_RUN = regex.compile(r" ?[\p{L}\p{M}]*")


class Pieces:
    """Looks up byte ranges in the vocabulary; ``len(pieces)`` stands for no piece."""

    BITS = 22

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        #: Lengths that a piece of a letter run can have.
        self.lengths = sorted({1} | {len(p) for p in pieces if IN_RUN.fullmatch(p.decode(errors="replace"))})
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        keys = bytehash.strings(raw, offsets)
        self.slots = np.full(1 << self.BITS, self.n, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.more = {}
        for i, s in enumerate(slot.tolist()):
            if self.slots[s] == self.n:
                self.slots[s] = i
            else:
                self.more[int(keys[i])] = i
        self.more_keys = np.array(sorted(self.more), np.uint64)
        self.more_ids = np.array([self.more[int(k)] for k in self.more_keys], np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)]
        ok = self.keys[at] == keys
        out = np.where(ok, at, self.n)
        clash = np.flatnonzero(~ok & (at != self.n))
        if len(clash) and len(self.more_keys):
            j = np.minimum(np.searchsorted(self.more_keys, keys[clash]), len(self.more_keys) - 1)
            hit = self.more_keys[j] == keys[clash]
            out[clash[hit]] = self.more_ids[j[hit]]
        return out

    def spans(self, letters: np.ndarray):
        """For words of one length (one a row): ids[i, j] of the pieces from i to j."""
        n, length = letters.shape
        prefix = bytehash.prefixes(letters.ravel())
        base = np.arange(n) * length
        return {
            (j - k, j): self.find(bytehash.mix(bytehash.ranges(prefix, base + j - k, base + j)))
            for j in range(1, length + 1)
            for k in self.lengths
            if k <= j
        }

    def endings(self, prefix: np.ndarray, n: int, length: int, a: int, b: int) -> np.ndarray:
        """For n padded words of one length: ids (n x b - a x lengths) of the pieces that end after a + 1 .. b bytes."""
        end = np.arange(a + 1, b + 1)[None, :, None]
        start = end - np.array(self.lengths)[None, None, :]
        base = (np.arange(n) * length)[:, None, None]
        keys = bytehash.mix(bytehash.ranges(prefix, (base + np.maximum(start, 0)).ravel(), np.broadcast_to(base + end, (n, *start.shape[1:])).ravel()))
        ids = self.find(keys).reshape(n, *start.shape[1:])
        return np.where(start >= 0, ids, self.n)


def forward(spans: dict, length: int, probs: np.ndarray) -> np.ndarray:
    """Log probabilities (words x languages), summed over all segmentations."""
    n, k = len(spans[0, 1]), probs.shape[1]
    longest = max(j - i for i, j in spans)
    values, log = [np.ones((n, k))], np.zeros((n, k))
    for j in range(1, length + 1):
        value = np.zeros((n, k))
        for i in range(max(0, j - longest), j):
            if (i, j) in spans:
                value += values[i] * probs[spans[i, j]]
        values.append(value)
        if j > longest:
            values[j - longest - 1] = None
        if j % RESCALE == 0 and j < length:
            log += np.log(value)
            for i in range(max(0, j - longest + 1), j):
                values[i] = values[i] / value
            values[j] = np.ones((n, k))
    return log + np.log(values[length])


def forward_long(find: Pieces, words: list[np.ndarray], probs: np.ndarray, keep: bool = False) -> list[np.ndarray]:
    """Log probabilities of each word (languages), or with ``keep`` of its every prefix (prefixes x languages).

    The words go side by side, the longest first, one byte a step.
    """
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order])
    n, length, k = len(order), int(sizes[0]), probs.shape[1]
    letters = np.zeros((n, length), np.uint8)
    for r, i in enumerate(order):
        letters[r, : len(words[i])] = words[i]
    prefix = bytehash.prefixes(letters.ravel())
    lengths = np.array(find.lengths)
    longest = int(lengths[-1])
    step = max(1, AT_A_TIME // (n * len(lengths)))
    values, log = np.zeros((n, longest + step, k)), np.zeros((n, k))
    values[:, longest - 1] = 1.0
    out = [np.zeros((int(m) + 1, k) if keep else k) for m in sizes]
    active = n
    for a in range(0, length, step):
        b = min(a + step, length)
        p = probs[find.endings(prefix, n, length, a, b)]
        for j in range(a, b):
            at = longest + j - a
            while sizes[active - 1] <= j:
                active -= 1
            value = np.einsum("nlk,nlk->nk", values[:active, at - lengths], p[:active, j - a])
            values[:active, at] = value
            if keep:
                for r in range(active):
                    out[r][j + 1] = log[r] + np.log(value[r])
            else:
                for r in range(active - 1, -1, -1):
                    if sizes[r] > j + 1:
                        break
                    out[r] = log[r] + np.log(value[r])
            if (j + 1) % RESCALE == 0:
                log[:active] += np.log(value)
                values[:active, max(0, at - longest + 1) : at + 1] /= value[:, None, :]
        values[:, :longest] = values[:, b - a : b - a + longest].copy()
    found: list = [None] * n
    for r, i in enumerate(order):
        found[i] = out[r]
    return found


def expected(spans: dict, length: int, probs: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds the expected piece counts of words (weight: words x languages) to counts."""
    n, k = weight.shape
    a = [np.ones((n, k))] + [None] * length
    by_end, by_start = [[] for _ in range(length + 1)], [[] for _ in range(length + 1)]
    for i, j in spans:
        by_end[j].append(i)
        by_start[i].append(j)
    for j in range(1, length + 1):
        a[j] = sum(a[i] * probs[spans[i, j]] for i in by_end[j])
    b = [None] * length + [np.ones((n, k))]
    for i in reversed(range(length)):
        b[i] = sum(b[j] * probs[spans[i, j]] for j in by_start[i])
    z = weight / np.maximum(a[length], 1e-300)
    for (i, j), ids in spans.items():
        if (ids < len(counts) - 1).any():
            mass = a[i] * probs[ids] * b[j] * z
            for c in range(k):
                counts[:, c] += np.bincount(ids, mass[:, c], len(counts))


def expected_long(find: Pieces, word: np.ndarray, probs: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """The same for one long word (weight: languages), by prefix and suffix probabilities in logarithms."""
    length, lengths = len(word), np.array(find.lengths)
    a = forward_long(find, [word], probs, keep=True)[0]
    longest, k = int(lengths[-1]), probs.shape[1]
    # The suffix probabilities: the same recurrence from the end, by the pieces that start at a place.
    prefix = bytehash.prefixes(word)
    step = max(1, AT_A_TIME // len(lengths))
    later, log = np.zeros((longest + 1, k)), np.zeros(k)
    later[0] = 1.0
    b = np.zeros((length + 1, k))
    for hi in range(length, 0, -step):
        lo = max(0, hi - step)
        start = np.arange(lo, hi)[:, None]
        end = start + lengths[None, :]
        ok = end <= length
        ids = np.where(ok, find.find(bytehash.mix(bytehash.ranges(prefix, np.broadcast_to(start, end.shape).ravel(), np.minimum(end, length).ravel()))).reshape(end.shape), find.n)
        p = probs[ids]
        for i in range(hi - 1, lo - 1, -1):
            value = np.einsum("lk,lk->k", later[lengths - 1], p[i - lo])
            later[1:] = later[:-1].copy()
            later[0] = value
            b[i] = log + np.log(value)
            if i % RESCALE == 0:
                log += np.log(value)
                later /= value
        mass = np.exp(a[start] + b[np.minimum(end, length)] - a[length]) * p * weight
        for c in range(k):
            counts[:, c] += np.bincount(ids.ravel(), mass[..., c].ravel(), len(counts))


def letter_runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case letter runs of each word, and their number."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+", " "), " ")
    lists = pc.split_pattern(clean, " ")
    empty = np.asarray(pc.equal(pc.binary_length(clean), 0))
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    keep = np.repeat(~empty, n)
    n[empty] = 0
    return flat.filter(pa.array(keep)), n


def by_length(runs: pa.Array):
    """(row numbers, bytes with a leading space) of the short runs of each length, in bounded blocks."""
    raw, offsets = utf8(runs)
    length = np.diff(offsets)
    for n in np.unique(length[length <= SHORT]):
        rows = np.flatnonzero(length == n)
        for a in range(0, len(rows), 50_000):
            part = rows[a : a + 50_000]
            letters = np.full((len(part), n + 1), 32, np.uint8)
            letters[:, 1:] = raw[offsets[part][:, None] + np.arange(n)[None, :]]
            yield part, letters


def long_runs(runs: pa.Array):
    """(row numbers, words with a leading space) of the long runs, those of about one length together, in bounded blocks."""
    raw, offsets = utf8(runs)
    length = np.diff(offsets)
    rows = np.flatnonzero(length > SHORT)
    rows = rows[np.argsort(length[rows], kind="stable")]
    a = 0
    while a < len(rows):
        b = a + 1
        while b < len(rows) and length[rows[b]] <= 2 * length[rows[a]] and (b - a + 1) * int(length[rows[b]]) <= AT_A_TIME:
            b += 1
        yield rows[a:b], [np.append(np.uint8(32), raw[offsets[r] : offsets[r + 1]]) for r in rows[a:b]]
        a = b


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], probs: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.probs, self.prior = pieces, languages, probs, prior
        self._find = None

    def find(self) -> Pieces:
        if self._find is None:
            self._find = Pieces(self.pieces)
        return self._find

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: no letter) and probability of each text."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        runs, n = letter_runs(coded.dictionary)
        coded_runs = runs.dictionary_encode()
        distinct = np.zeros((len(coded_runs.dictionary), len(self.languages)))
        for rows, letters in by_length(coded_runs.dictionary):
            distinct[rows] = forward(self.find().spans(letters), letters.shape[1], self.probs)
        for rows, words in long_runs(coded_runs.dictionary):
            distinct[rows] = forward_long(self.find(), words, self.probs)
        words = sums(distinct[np.asarray(coded_runs.indices)], n)
        index = np.asarray(coded.indices)
        total = sums(words[index], per_text)
        letters = sums((n > 0)[index].astype(np.int64), per_text)
        total += self.prior
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return np.where(letters > 0, best, -1), np.where(letters > 0, p[np.arange(len(best)), best], 0.0)


def fit(rows: list[tuple[str, str]], model_file: str) -> Model | None:
    """rows: (language, text).  None if there is nothing to learn from."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    lists = pc.ascii_split_whitespace(pa.array([t or "" for _, t in rows]))
    runs, n = letter_runs(lists.flatten())
    per_text = sums(n, np.asarray(pc.list_value_length(lists)).astype(np.int64))
    of = np.repeat([number[lang] for lang, _ in rows], per_text)
    coded = runs.dictionary_encode()
    counts = np.bincount(np.asarray(coded.indices) * len(languages) + of, minlength=len(coded.dictionary) * len(languages)).reshape(-1, len(languages)).astype(float)
    pieces = vocabulary(model_file)
    find = Pieces(pieces)
    blocks = [(find.spans(letters), letters.shape[1], counts[part]) for part, letters in by_length(coded.dictionary)]
    long = [(word, counts[row]) for part, words in long_runs(coded.dictionary) for row, word in zip(part, words)]
    length = np.array([len(p) for p in pieces])
    probs = np.repeat((0.01 ** (1.0 / length) / len(pieces))[:, None], len(languages), axis=1)
    probs = np.vstack([probs, np.zeros((1, len(languages)))])
    for _ in range(ROUNDS):
        mass = np.zeros_like(probs)
        for spans, size, weight in blocks:
            expected(spans, size, probs, weight, mass)
        for word, weight in long:
            expected_long(find, word, probs, weight, mass)
        mass[:-1] += SMOOTHING
        mass[-1] = 0
        probs = mass / mass.sum(axis=0)
    rows_of = np.bincount([number[lang] for lang, _ in rows], minlength=len(languages))
    return Model(pieces, languages, probs, np.log(rows_of / rows_of.sum()))


def labelled_sample(df: DataFrame, label: str, per_label: int, characters: int) -> DataFrame:
    """About ``per_label`` rows of each label and at most about ``characters`` of text, chosen by a hash of the id (all rows where there are fewer)."""
    sizes = {r[0]: min(1.0, per_label / r[1], characters / max(1, r[2])) for r in df.groupBy(label).agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()}
    if not sizes:
        return df
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(1 << 20)) < F.element_at(share, F.col(label)) * (1 << 20))


def identify(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    docs = pick(df, id=id_col, text=text_col, lang=lang_col).withColumn("held_out", held_out("id"))
    known = docs.where(~F.col("held_out") & F.col("lang").isNotNull()).select("id", "lang", "text")
    sample = labelled_sample(known, "lang", fit_rows, FIT_CHARACTERS).select("lang", "text").toArrow()
    model = fit(list(zip(sample["lang"].to_pylist(), sample["text"].to_pylist())), model_file)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                if model is None:
                    names, score = pa.array([UNKNOWN] * part.num_rows), np.zeros(part.num_rows)
                else:
                    best, score = model.score(part.column(1))
                    names = pa.array([*model.languages, UNKNOWN]).take(pa.array(np.where(best < 0, len(model.languages), best)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), names, pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", "text", "held_out").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
