"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import by_bytes, map_arrow, texts_of
from ._words import mix

_LETTERS = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s|[\W\d_](?=\W)")
UNDETERMINED = "und"

#: Letters of a position of the chain; longer runs of letters are several.
LONGEST = 40


def letter_words(text: str) -> list[str]:
    """Runs of letters, in lower case (number signs that are no letters fall out)."""
    found = _LETTERS.findall(text.lower())
    return found if "".join(found).isalpha() or not found else [w for w in found if any(map(str.isalpha, w))]


def positions(words: list[str]) -> list[str]:
    """The positions of the chain: words, but runs of more than LONGEST letters as consecutive pieces of that many.

    A piece begins with ^ if the run begins there, else with ~, and ends with $ if the run ends there, else with
    the two next letters, so that runs of two and three letters over its end count.
    """
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
            continue
        for a in range(0, len(w), LONGEST):
            b = a + LONGEST
            out.append(("~" if a else "^") + (w[a:] + "$" if b >= len(w) else w[a : b + 2]))
    return out


def word_features(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature id) pairs, for all words at once; ids are hashes below ``size``, a power of two.

    With ^ and $ for the ends of a word: the word itself (lexicon), all runs of two and three characters, and at both
    ends also those of four and five, so affixes of up to four letters. ``words``: as ``positions`` gives them; a
    piece of a longer run has affixes only where the run begins or ends.
    """
    marked = [w.removeprefix("~") if w[0] in "^~" else f"^{w}$" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = mix(letters.astype(np.uint64))
    lengths = np.array([len(m) for m in marked], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    left = lengths[owner] - place
    owners, ids = [], []
    with np.errstate(over="ignore"):
        run = codes
        for n in range(2, 6):
            run = mix(run[: len(codes) - n + 1] + codes[n - 1 :] * np.uint64(2 * n + 1) + np.uint64(n))
            whole = left[: len(run)] >= n
            if n > 3:
                whole &= (letters[: len(run)] == ord("^")) | ((left[: len(run)] == n) & (letters[n - 1 :] == ord("$")))
            at = np.flatnonzero(whole)
            owners.append(owner[at])
            ids.append(run[at])
        each = mix(codes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        owners.append(np.arange(len(words)))
        ids.append(mix(np.add.reduceat(each, starts) + np.uint64(77)) if len(words) else codes)
    return np.concatenate(owners), (np.concatenate(ids) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Crf:
    """Emission weights over hashed features, and transition scores between the labels of neighbouring words."""

    labels: list[str]
    weights: np.ndarray  # (2**bits, labels)
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, labels) emission scores."""
        owner, ids = word_features(words, len(self.weights))
        return np.stack([np.bincount(owner, self.weights[ids, k], len(words)) for k in range(len(self.labels))], axis=1).astype(np.float32)

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over padded sequences: scores (time, sequences, labels) -> probabilities of the labels there.

        Steps past a sequence's end are neutral. Work in place of logarithms: rows are rescaled at each step.
        """
        steps, n, k = scores.shape
        live = np.arange(steps)[:, None] < lengths[None, :]
        fore = self.forward(scores)
        emit, turn = np.exp(scores - scores.max(axis=2, keepdims=True)), self._moves().T.copy()
        back = np.ones((n, k), scores.dtype)
        for t in range(steps - 2, -1, -1):
            step = (back * emit[t + 1]) @ turn
            step /= step.sum(axis=1, keepdims=True)
            back = step if live[t + 1].all() else np.where(live[t + 1][:, None], step, back)
            fore[t] *= back
        fore /= fore.sum(axis=2, keepdims=True)
        fore[~live] = 0
        return fore

    def _moves(self) -> np.ndarray:
        return np.exp(self.transitions - self.transitions.max())

    def forward(self, scores: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Chances of the labels given the words so far; ``before``: those at the word before the first one, if there is one."""
        emit, move = np.exp(scores - scores.max(axis=2, keepdims=True)), self._moves()
        fore = np.empty(scores.shape, scores.dtype)
        now = np.exp(self.start - self.start.max()) if before is None else before @ move
        for t in range(len(scores)):
            now = (now if not t else now @ move) * emit[t]
            now /= now.sum(axis=1, keepdims=True)
            fore[t] = now
        return fore

    def sums(self, parts: Callable[[int], np.ndarray], many: int) -> tuple[np.ndarray, int]:
        """Sums of the probabilities of the labels over one long sequence, and its words, a part of it in memory at a time.

        ``parts(i)``: the scores (words, labels) of the i-th of ``many`` parts. Forward over all parts, of which only the
        last state is kept, then backward, each part's forward states made anew from the state before it.
        """
        states: list[np.ndarray | None] = [None]
        for i in range(many):
            scores = parts(i)
            states.append(self.forward(scores[:, None], states[-1])[-1] if len(scores) else states[-1])
        turn, total, words = self._moves().T.copy(), np.zeros(len(self.labels)), 0
        back = np.ones((1, len(self.labels)), self.transitions.dtype)  # what the words behind a part say about its last one
        for i in range(many - 1, -1, -1):
            scores = parts(i)[:, None]
            if not len(scores):
                continue
            fore, emit = self.forward(scores, states[i]), np.exp(scores - scores.max(axis=2, keepdims=True))
            for t in range(len(scores) - 1, -1, -1):
                fore[t] *= back
                back = (back * emit[t]) @ turn
                back /= back.sum(axis=1, keepdims=True)
            fore /= fore.sum(axis=2, keepdims=True)
            total += fore.sum(axis=(0, 1), dtype=np.float64)
            words += len(scores)
        return total, words


def stretches(text: str, most: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches of about ``most`` characters that begin and end with words."""
    cuts = [0]
    while cuts[-1] + most < len(text):
        gap = _GAP.search(text, cuts[-1] + most)
        if gap is None:
            break
        cuts.append(gap.end())
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def train(texts: list[str], labels: list[str], *, bits: int = 17, length: int = 48, rounds: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Crf:
    """Fit by gradient ascent (AdaGrad) on the likelihood of word labels.

    Each text's words carry its label. Training sequences are spliced from stretches of 4 to ``length`` words of random
    texts, so that the transitions see both runs of a language and switches.
    """
    names = sorted(set(labels))
    draw = np.random.Generator(np.random.PCG64(seed))
    words = [positions(letter_words(t)) for t in texts]
    usable = [i for i, w in enumerate(words) if w]
    crf = Crf(names, np.zeros((1 << bits, len(names)), np.float32), np.zeros((len(names), len(names)), np.float32), np.zeros(len(names), np.float32))
    if not usable or len(names) < 2:
        return crf
    vocabulary: dict[str, int] = {}
    sequences = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words[i]], np.int64) for i in usable]
    tags = np.array([names.index(labels[i]) for i in usable])
    owner, flat = word_features(list(vocabulary), len(crf.weights))
    flat = flat[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner, minlength=len(vocabulary))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    square, square_moves, square_start = np.full_like(crf.weights, 1e-3), np.full_like(crf.transitions, 1e-3), np.full_like(crf.start, 1e-3)
    by_tag = [np.flatnonzero(tags == k) for k in range(len(names))]
    steps = rounds * max(1, sum(min(len(s), 400) for s in sequences) // (batch * length))
    for _ in range(steps):
        ids, gold = np.zeros((length, batch), np.int64), np.zeros((length, batch), np.int64)
        for b in range(batch):
            at = 0
            while at < length:  # languages alike, so that none is a default
                k = draw.choice(by_tag[draw.integers(len(names))])
                take = min(length - at, len(sequences[k]), int(draw.integers(4, length + 1)))
                first = int(draw.integers(0, len(sequences[k]) - take + 1))
                ids[at : at + take, b] = sequences[k][first : first + take]
                gold[at : at + take, b] = tags[k]
                at += take
        distinct, where = np.unique(ids, return_inverse=True)
        spans = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in distinct])
        used = flat[spans]
        owner = np.repeat(np.arange(len(distinct)), sizes[distinct])
        table = np.add.reduceat(crf.weights[used], np.concatenate(([0], np.cumsum(sizes[distinct])[:-1])), axis=0)
        scores = table[where.reshape(length, batch)]
        chance, pairs = _expected(crf, scores)
        error = -chance
        t, b = np.indices(gold.shape)
        error[t, b, gold] += 1
        per_word = np.zeros_like(table)
        np.add.at(per_word, where.reshape(-1), error.reshape(-1, len(names)))
        touched, slot = np.unique(used, return_inverse=True)
        gradient = np.zeros((len(touched), len(names)), np.float32)
        np.add.at(gradient, slot, per_word[owner])
        gradient = gradient / batch - 1e-4 * crf.weights[touched]
        square[touched] += gradient**2
        crf.weights[touched] += rate * gradient / np.sqrt(square[touched])
        seen = np.zeros_like(crf.transitions)
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        moves = (seen - pairs) / batch
        square_moves += moves**2
        crf.transitions += rate * moves / np.sqrt(square_moves)
        begin = (np.bincount(gold[0], minlength=len(names)) - chance[0].sum(axis=0)).astype(np.float32) / batch
        square_start += begin**2
        crf.start += rate * begin / np.sqrt(square_start)
    return crf


def _expected(crf: Crf, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels and expected counts of neighbouring labels, for sequences of one length."""
    steps, n, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(crf.transitions - crf.transitions.max())
    fore, back = np.empty_like(emit), np.ones_like(emit)
    fore[0] = emit[0] * np.exp(crf.start - crf.start.max())
    fore[0] /= fore[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (fore[t - 1] @ move) * emit[t]
        fore[t] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k), np.float32)
    for t in range(steps - 2, -1, -1):
        ahead = back[t + 1] * emit[t + 1]
        joint = fore[t][:, :, None] * move[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = ahead @ move.T
        back[t] = x / x.sum(axis=1, keepdims=True)
    chance = fore * back
    return chance / chance.sum(axis=2, keepdims=True), pairs


def training_sample(docs: DataFrame, *, text: str = "text", label: str = "lang", id_col: str = "doc_id", per_label: int = 400, most_rows: int = 20000, most_chars: int = 64 << 20) -> tuple[list[str], list[str]]:
    """At most ``per_label`` labelled texts of every label, whole ones.

    The rows of least hash are taken, of equal hashes by id and text. With many labels there are fewer rows of each,
    ``most_rows`` in all but at least one a label; and a row is taken only if the texts of its label up to it have no more than
    the label's share of ``most_chars`` characters. So what reaches the driver is bounded but for the number of labels.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    common = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).collect()
    if not common:
        return [], []
    each = max(1, min(per_label, most_rows // len(common)))
    near = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40))
    few = docs.sparkSession.createDataFrame([(r[0], k, min(1 << 40, (4 * each + 32) * (1 << 40) // r[1] + 1)) for k, r in enumerate(common)], f"label {docs.schema[label].dataType.simpleString()}, rank int, below long")
    drawn = rows.select(F.col(label).alias("label"), near.alias("near"), F.col(id_col).alias("id"), F.length(text).alias("size"), F.col(text).alias("text")).join(F.broadcast(few), "label").where("near < below").where(F.col("size") <= most_chars // len(common))
    order = Window.partitionBy("label").orderBy("near", "id", "text")
    drawn = drawn.withColumns({"nth": F.row_number().over(order), "so_far": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    kept = drawn.where((F.col("nth") <= each) & (F.col("so_far") <= most_chars // len(common)))
    taken = sorted(kept.select("rank", "nth", "label", "text").collect(), key=lambda r: r[:2])
    return [r["text"] for r in taken], [r["label"] for r in taken]


def tag_documents(docs: DataFrame, crf: Crf, *, text: str = "text", cells: int = 1 << 19, stretch: int = 1 << 21) -> DataFrame:
    """``docs`` with lang_pred, score and word_share (a map label -> share of the words), for every whole text.

    Each word of a text is labelled by forward-backward over the whole text; a run of more than 40 letters (as in
    scripts without blanks) counts as a word for each 40 letters or rest. lang_pred is the label with the largest sum of
    probabilities (of equal ones the first in order), score that sum over the number of words. ``und`` with score 0 if the
    text is null or has no letter. A text of more than ``stretch`` characters is read in stretches of about that many, twice
    (see ``Crf.sums``), so memory doesn't follow its length; the result is the same. Columns
    pass through (those three are replaced); an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)  # its size follows from its parameters
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "word_share")]
    tagged = docs.select(*[F.col(f"`{c}`") for c in names])

    def make():
        crf, known = model.value, {}
        k = len(crf.labels)
        table = np.zeros((min(1 << 18, max(1 << 12, (1 << 24) // max(1, k))), k), np.float32)

        def scores_of(words: list[list[str]]) -> list[np.ndarray]:
            """Scores of the words of some texts; each distinct word is scored once, until the table is full."""
            new = list(set().union(*words).difference(known))
            if len(known) + len(new) > len(table):
                known.clear()
                new = list(set().union(*words))
            if len(new) > len(table):
                return [crf.word_scores(w) for w in words]
            if new:
                table[len(known) : len(known) + len(new)] = crf.word_scores(new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            return [table[np.fromiter(map(known.__getitem__, w), np.int64, len(w))] for w in words]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, text)
            scores: list[np.ndarray] = []
            for a, b in by_bytes([len(x) for x in texts], 2 << 20):
                scores += scores_of([positions(letter_words(x)) if k and len(x) <= stretch else [] for x in texts[a:b]])  # without labels nothing can be said
            sizes = np.array([len(x) for x in scores], np.int64)
            sums = np.zeros((len(texts), k))
            for i in (i for i, x in enumerate(texts) if k and len(x) > stretch):
                spans = stretches(texts[i], stretch)
                part = lambda j, x=texts[i], spans=spans: scores_of([positions(letter_words(x[slice(*spans[j])]))])[0]
                sums[i], sizes[i] = crf.sums(part, len(spans))
                scores[i] = None
            order = np.argsort(-sizes, kind="stable")
            order = np.array([i for i in order if sizes[i] and scores[i] is not None], np.int64)
            at = 0
            while at < len(order):  # texts of like length side by side, padded to the longest
                longest = int(sizes[order[at]])
                fit = int(np.searchsorted(-sizes[order], -longest / 1.5, "right"))
                group = order[at : max(at + 1, min(fit, at + max(1, cells // (longest * max(1, k // 8)))))]
                padded = np.zeros((longest, len(group), k), np.float32)
                for c, i in enumerate(group):
                    padded[: sizes[i], c] = scores[i]
                    scores[i] = scores[i][:0]
                sums[group] = crf.posteriors(padded, sizes[group]).sum(axis=0)
                at += len(group)
            share = sums / np.maximum(sizes, 1)[:, None]
            best = share.argmax(axis=1) if k else np.zeros(len(texts), np.int64)
            langs = [crf.labels[j] if n and k else UNDETERMINED for j, n in zip(best, sizes, strict=True)]
            top = np.clip(share.max(axis=1), 0, 1) if k else np.zeros(len(texts))
            shares = pa.array([list(zip(crf.labels, row)) if n else [] for row, n in zip(share.tolist(), sizes, strict=True)], pa.map_(pa.string(), pa.float64()))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(top, pa.float64()), shares], [*batch.schema.names, "lang_pred", "score", "word_share"])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema) + ", lang_pred string, score double, word_share map<string,double>"
    return map_arrow(tagged, make, schema)


def identify_languages(docs: DataFrame, *, text: str = "text", label: str = "lang", id_col: str = "doc_id", held_out: int = 5, **sample) -> DataFrame:
    """``docs`` with held_out, lang_pred, score, word_share.

    The model learns from the text and the label of rows whose crc32(id as text) mod ``held_out`` is not 0; a null id is
    never held out nor learned from. Label, source and id are no inputs of a prediction. If nothing can be learned every
    text is ``und``.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out
    rows = docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
    texts, labels = training_sample(docs.where(fold != 0), text=text, label=label, id_col=id_col, **sample)
    return tag_documents(rows, train(texts, labels), text=text)
