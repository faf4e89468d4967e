"""Languages of documents and of the parts of mixed ones.

Script ranges narrow the candidates of each word (a letter of Kana, Han or Cyrillic
leaves one or two); a model of words and letter groups, fitted on a bounded sample of
labelled rows, scores the others.  Viterbi over the per-word scores with a penalty
for each change of language labels spans; a change at a line break costs less.  The
documents of a batch are decoded together, one step for all of them at a time.  The
confidence of a document or line is the posterior probability of its language by the
forward-backward sums of the same model, the mean over its letters.

Defined results
* null and empty texts and those without running text have no language: no rows from
  ``found`` and ``label_parts``, one row with null from ``main_languages``;
* a document's main language is that of most of its letters; equal shares go to the
  language that comes first in ``LANGUAGES``;
* lines are parts between line feeds, empty ones counted; titles, headings, formulas,
  lone names and lines under ``LEAST_LINE`` characters have no language of their own;
* very long texts are labelled whole; repeated rows give repeated results;
* an empty table gives an empty table; a table without usable labels is scored with
  the fixed words of ``COMMON`` alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.session import ship

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja")
LATIN = 7
#: Other names of a language that a label may use.
OTHER_NAMES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "dut": "nl", "nld": "nl", "rus": "ru", "chi": "zh", "zho": "zh", "jpn": "ja"}
#: Common words of each language with Latin letters.
COMMON = {
    "en": "the of and is to in that with for by which are this at least be from has not it wherein",
    "de": "der die das und ist mit wird den dem ein eine von zu nicht sich wenn auf nach wobei einen",
    "fr": "le la les des est une dans et du avec sur pas que par pour qui selon au lorsque ne",
    "es": "el los las del una que con por se es para según más cuando sin y no en al como",
    "it": "il lo gli della che con una per non è di nel dal viene si al più quando come secondo",
    "pt": "o os as da do uma que com por não é em no ao mais quando para de acordo como",
    "nl": "het een van en is met wordt voor niet dat op te door waarbij de bij wanneer volgens tot ook",
}
#: Labelled rows of each language that the model is fitted on, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 250, 20_000
#: Penalties for a change of language between words and at a line break, and the least score of a word.
CHANGE, CHANGE_AT_BREAK, LEAST = 9.0, 4.0, -7.0
LEAST_LINE = 20
#: Letters that a letter of Kana or Han counts as, when languages' parts of a text are compared.
CLOSE_WEIGHT = 2
#: Tokens decoded together at most, and words that a task remembers.
TOGETHER, REMEMBERED = 1 << 19, 400_000
#: Tokens of a piece whose posteriors are computed together, and of the margins in which the state settles.
PIECE, SETTLE = 2048, 128

_TOKEN = re.compile("\n|[^\\W\\d_぀-ヿ㐀-鿿ｦ-ﾟ]+|[぀-ヿｦ-ﾟ]|[㐀-鿿]")
_CLOSE, _LETTERS = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]"), re.compile(r"[^\W\d_]+")
_KANA, _HAN, _CYRILLIC = re.compile("[぀-ヿｦ-ﾟ]"), re.compile("[㐀-鿿]"), re.compile("[Ѐ-ӿ]")


def _script(token: str) -> tuple[int, ...]:
    """Candidates of a word by its first letter that belongs to one script."""
    if _KANA.match(token):
        return (9,)
    if _HAN.match(token):
        return (8, 9)
    if _CYRILLIC.search(token):
        return (7,)
    return tuple(range(LATIN))


def _groups(word: str) -> Iterator[str]:
    """Letter groups of a word with its borders."""
    w = f"_{word}_"
    for n in (2, 3, 4):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class Model:
    """Scores of words by language: relative frequencies of words, over those of letter groups."""

    def __init__(self, words: dict[str, np.ndarray], groups: dict[str, np.ndarray], totals: np.ndarray):
        self.words, self.groups, self.totals = words, groups, totals

    @classmethod
    def fit(cls, lines: list[tuple[list[str], int]]) -> Model:
        """From (words of a line, language) pairs."""
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES), np.float32))
        for lang, common in COMMON.items():
            for w in common.split():
                words[w][LANGUAGES.index(lang)] += 20
        for tokens, lang in lines:
            for w in tokens:
                words[w][lang] += 1
        totals = sum(words.values(), np.zeros(len(LANGUAGES), np.float64))
        groups: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES), np.float32))
        for w, n in words.items():
            if _script(w)[0] < LATIN:
                # Each word counts by its logarithm, so that a few frequent ones don't make up the groups.
                weight = np.log1p(n)
                for g in _groups(w):
                    groups[g] += weight
        sums = np.maximum(sum(groups.values(), np.zeros(len(LANGUAGES), np.float64)), 1)
        shares = {g: np.log((n + 0.05) / (sums + 50)).astype(np.float32) for g, n in groups.items()}
        return cls(dict(words), shares, totals)

    def score(self, token: str) -> np.ndarray:
        """log P(language | word) over all languages, at least ``LEAST``."""
        out = np.full(len(LANGUAGES), LEAST, np.float32)
        may = np.array(_script(token))
        if len(may) == 1:
            out[may] = 0
            return out
        prior = np.full(len(may), 1 / len(may))
        if may[0] < LATIN:
            rows = [self.groups[g] for g in _groups(token) if g in self.groups]
            if rows:
                s = np.sum(rows, axis=0)[may] * 0.6
                prior = np.exp(s - s.max())
                prior /= prior.sum()
        seen = self.words.get(token)
        if seen is not None:
            rate = seen[may] / np.maximum(self.totals[may], 1) * self.totals[may].mean()
        else:
            rate = np.zeros(len(may))
        p = (rate + 1.5 * prior) / (rate.sum() + 1.5)
        out[may] = np.maximum(np.log(np.maximum(p, 1e-9)), LEAST)
        return out


def tokens_of(text: str) -> list[str]:
    """Line feeds and words in order; each letter of a script without spaces is a word.

    Texts without such letters are only split at white space, which leaves marks on the
    words; ``bare`` takes them off, once for each distinct word.
    """
    text = text.lower()
    if _CLOSE.search(text):
        return _TOKEN.findall(text)
    return text.replace("\n", " \0 ").split()


def bare(token: str) -> str:
    """The letters of a word, without marks and figures around and in it."""
    return token if token.isalpha() else "".join(_LETTERS.findall(token))


def fit_on(texts: list[str], labels: list[str], passes: int = 2) -> Model:
    """A model from labelled texts, whose lines are labelled anew by the model of the pass before."""
    lines: list[tuple[list[str], int]] = []
    for text, label in zip(texts, labels):
        lang = LANGUAGES.index(label)
        at: list[str] = []
        for token in [*tokens_of(text), "\n"]:
            if token in ("\n", "\0"):
                if len(at) >= 4:
                    lines.append((at, lang))
                at = []
            elif word := bare(token):
                at.append(word)
    # Where a script leaves one language, the label doesn't matter.
    model = Model.fit([(w, l) for w, l in lines if any(l in _script(t) for t in w)])
    for _ in range(passes):
        known: dict[str, np.ndarray] = {}
        anew = []
        for tokens, _l in lines:
            total = np.zeros(len(LANGUAGES))
            for t in tokens:
                if t not in known:
                    known[t] = model.score(t)
                total += known[t]
            anew.append((tokens, int(total.argmax())))
        model = Model.fit(anew)
    return model


_MARKS = re.compile(r"^\s*(?:\[\d+\]|\(?\d+[.)])\s*")
_WORD = re.compile(r"[^\W\d_]{2,}")
_ENDS = re.compile(r"[.;:!?。；：！？][\"'»”’)\]\s]*$")
_INNER = re.compile(r"[.!?] [^\W\d_]|[。，、；]|, ")
_FORMULA = re.compile(r"<m[a-z]*>|</m|\\[a-z]+\{|\\frac|\$\$|\[\[EQ|[∑∂∇→=]")


def is_running(line: str) -> bool:
    """Whether a line is running text: no title, heading, formula or lone name."""
    bare = _MARKS.sub("", line.strip())
    if len(line.strip()) < LEAST_LINE or _FORMULA.search(bare):
        return False
    close = len(_KANA.findall(bare)) + len(_HAN.findall(bare))
    if close >= 8:
        return bool(_ENDS.search(bare) or _INNER.search(bare))
    words = _WORD.findall(bare)
    letters = sum(map(len, words))
    if len(words) < 4 or letters < 0.5 * len(bare.replace(" ", "")):
        return False
    return bool(_ENDS.search(bare)) or len(words) >= 10 or (len(words) >= 6 and bool(_INNER.search(bare)))


class _Words(dict):
    """Numbers of words; asking for an unknown one gives it the next number."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        self.new.append(word)
        return n


class Labeller:
    """Labels the words of many texts at a time."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.scores, self.sizes = np.zeros((1 << 12, len(LANGUAGES)), np.float32), np.zeros(1 << 12, np.int64)
        # Both marks of a line's end have number 0.
        self.words["\n"]
        self.words["\0"] = 0

    def numbers(self, text: str) -> np.ndarray:
        found = tokens_of(text)
        return np.fromiter(map(self.words.__getitem__, found), np.int32, len(found))

    def learn(self) -> None:
        new, self.words.new = [w for w in self.words.new if w != "\n"], []
        n = len(self.words)
        if n > len(self.sizes):
            self.scores, self.sizes = np.resize(self.scores, (2 * n, len(LANGUAGES))), np.resize(self.sizes, 2 * n)
        for w in new:
            i, letters = self.words[w], bare(w)
            if letters:
                self.scores[i], self.sizes[i] = self.model.score(letters), len(letters) * (CLOSE_WEIGHT if _CLOSE.match(letters) else 1)
            else:
                self.scores[i], self.sizes[i] = 0, 0

    def constant(self, texts: list[np.ndarray]) -> np.ndarray:
        """The language of each text for which one language throughout is the best path, else -1.

        No path with a change scores more than the sum of the words' best scores less the
        smallest penalty, so a language that reaches this is the best path.
        """
        sizes = np.array([len(t) for t in texts])
        out = np.full(len(texts), -1, np.int8)
        if not sizes.any():
            return out
        score = self.scores[np.concatenate(texts)]
        some = np.flatnonzero(sizes)
        starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
        each = np.add.reduceat(score, starts, axis=0, dtype=np.float64)
        most = np.add.reduceat(score.max(axis=1), starts, dtype=np.float64)
        best = each.argmax(axis=1)
        out[some] = np.where(each[np.arange(len(some)), best] >= most - CHANGE_AT_BREAK, best, -1)
        return out

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The language of each word of each text, by Viterbi over all texts at a time."""
        plain = self.constant(texts)
        out = [np.full(len(t), max(k, 0), np.int8) for t, k in zip(texts, plain)]
        order = sorted(np.flatnonzero(plain < 0).tolist(), key=lambda i: -len(texts[i]))
        a = 0
        while a < len(order) and len(texts[order[a]]):
            most = len(texts[order[a]])
            b = min(len(order), a + max(1, TOGETHER // most))
            part = [texts[i] for i in order[a:b] if len(texts[i])]
            for i, labels in zip(order[a:b], self._decode(part, most)):
                out[i] = labels
            a = b
        return out

    def _decode(self, part: list[np.ndarray], steps: int) -> list[np.ndarray]:
        n, k = len(part), len(LANGUAGES)
        grid, running = _columns(part, steps)
        best = np.zeros((n, k), np.float32)
        came = np.zeros((steps, n), np.int8)
        changed = np.zeros((steps, n, k), bool)
        rows = np.arange(n)
        for t in range(steps):
            m = running[t]
            if t:
                top = best[:m].argmax(axis=1)
                other = best[rows[:m], top] - np.where(grid[t - 1, :m] == 0, CHANGE_AT_BREAK, CHANGE)
                swap = best[:m] < other[:, None]
                came[t, :m], changed[t, :m] = top, swap
                best[:m] = np.where(swap, other[:, None], best[:m])
            best[:m] += self.scores[grid[t, :m]]
        labels = np.zeros((steps, n), np.int8)
        state = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = running[t]
            labels[t, :m] = state[:m]
            state[:m] = np.where(changed[t, rows[:m], state[:m]], came[t, :m], state[:m])
        return [labels[: len(p), j] for j, p in enumerate(part)]

    def posterior(self, texts: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each word's label given all words, by forward and backward sums over pieces of all texts at a time."""
        out = [np.ones(len(t), np.float32) for t in texts]
        pieces = [(i, a, max(a - SETTLE, 0), min(a + PIECE + SETTLE, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
        pieces.sort(key=lambda p: p[2] - p[3])
        a = 0
        while a < len(pieces):
            steps = pieces[a][3] - pieces[a][2]
            b = min(len(pieces), a + max(1, TOGETHER // steps))
            part = [texts[i][lo:hi] for i, _, lo, hi in pieces[a:b]]
            grid, running = _columns(part, steps)
            emit = np.exp(self.scores)[grid]
            n, k = emit.shape[1:]
            change = np.where(grid == 0, np.float32(np.exp(-CHANGE_AT_BREAK)), np.float32(np.exp(-CHANGE)))[:, :, None]
            forward = np.empty((steps, n, k), np.float32)
            state = np.full((n, k), 1.0 / k, np.float32)
            for t in range(steps):
                m = running[t]
                if t:
                    state = state[:m] * (1 - change[t - 1, :m]) + change[t - 1, :m]
                state = state[:m] * emit[t, :m]
                state /= state.sum(axis=1, keepdims=True)
                forward[t, :m] = state
            back = np.ones((n, k), np.float32)
            for t in range(steps - 1, -1, -1):
                m = running[t]
                both = forward[t, :m] * back[:m]
                forward[t, :m] = both / both.sum(axis=1, keepdims=True)
                if t:
                    ahead = back[:m] * emit[t, :m]
                    ahead /= ahead.sum(axis=1, keepdims=True)
                    back[:m] = ahead * (1 - change[t - 1, :m]) + change[t - 1, :m]
            for j, (i, at, lo, _) in enumerate(pieces[a:b]):
                end = min(at + PIECE, len(texts[i]))
                out[i][at:end] = forward[np.arange(at - lo, end - lo), j, labels[i][at:end]]
            a = b
        return out

    def label(self, texts: list[str | None], confidence: bool = True, every: bool = False) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """For each text with running text: (its place, [(line_no, language, confidence)]); line 0 is the whole text, the rest are lines in other languages.

        With ``every`` the other texts too, with no rows.
        """
        if len(self.words) > REMEMBERED:
            self._forget()
        numbers = [self.numbers(t or "") for t in texts]
        self.learn()
        decoded = self.decode(numbers)
        sure = self.posterior(numbers, decoded) if confidence else None
        for i, (tokens, labels) in enumerate(zip(numbers, decoded)):
            rows = self._parts(texts[i], tokens, labels, sure[i] if confidence else None) if len(tokens) else []
            if rows or every:
                yield i, rows

    def _parts(self, text: str, tokens: np.ndarray, labels: np.ndarray, sure: np.ndarray | None) -> list[tuple[int, int, float]]:
        size = self.sizes[tokens]
        line = np.cumsum(tokens == 0)
        by_line = np.bincount(line * len(LANGUAGES) + labels, weights=size, minlength=(line[-1] + 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        own = by_line.argmax(axis=1)
        main = int(by_line.sum(axis=0).argmax())
        odd = np.flatnonzero((own != main) & (by_line.sum(axis=1) > 0))
        kept = text.split("\n") if len(odd) else None
        if not (is_running_text(text) if kept is None else any(map(is_running, kept))):
            return []
        rows = [(0, main, _confidence(sure, size, labels == main))]
        return rows + [(int(j) + 1, int(own[j]), _confidence(sure, size, (line == j) & (labels == own[j]))) for j in odd if is_running(kept[j])]


def _columns(part: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps x texts) numbers of texts that come longest first, and how many of them are longer than each step."""
    sizes = np.array([len(p) for p in part])
    grid = np.zeros((steps, len(part)), np.int32)
    for j, p in enumerate(part):
        grid[: len(p), j] = p
    return grid, np.searchsorted(-sizes, -np.arange(steps), "left")


def is_running_text(text: str) -> bool:
    """Whether any line is running text; stops at the first."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if end - at >= LEAST_LINE and is_running(text[at:end]):
            return True
        at = end + 1
    return False


def _confidence(sure: np.ndarray | None, size: np.ndarray, of: np.ndarray) -> float:
    """Mean posterior of the words that have the language, by letters; 0 where none is asked for."""
    if sure is None:
        return 0.0
    weight = size[of]
    return float(sure[of] @ weight / weight.sum()) if weight.any() else 1.0 / len(LANGUAGES)


def label_language(label: Column) -> Column:
    """The language that a label names, or null; letter case and an added region don't matter."""
    low = F.lower(F.trim(label))
    code = F.regexp_extract(low, r"^([a-z]{2,3})(?:[-_][a-z0-9-_]*)?$", 1)
    other = F.lit(None).cast("string")
    for name, lang in OTHER_NAMES.items():
        other = F.when(code == name, lang).otherwise(other)
    return F.when(code.isin(*LANGUAGES), code).otherwise(other)


def sample_rows(documents: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, language) of at most ``rows`` labelled rows of each language, the same at every call: a bounded sample for the fit."""
    lang = label_language(F.col(lang_col))
    size = F.length(F.col(text_col))
    able = documents.select(F.col(text_col).alias("text"), lang.alias("lang"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h")).filter(
        F.col("lang").isNotNull() & size.between(200, SAMPLE_CHARS)
    )
    counts = {r[0]: r[1] for r in able.groupBy("lang").count().collect()}
    if not counts:
        return []
    # About twice as many as wanted by a threshold on the hash, then exactly as many, so no language is gathered whole.
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, 2.0 * rows / n + 20.0 / n)).otherwise(share)
    few = able.filter((F.col("h").cast("double") / 2.0**64 + 0.5) < share)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= rows)
    return [(r["text"], r["lang"]) for r in ranked.select("text", "lang").collect()]


def fit_model(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model fitted on a bounded sample of the labelled rows."""
    sample = sorted(sample_rows(documents, rows))
    return fit_on([t for t, _ in sample], [l for _, l in sample])


def label_parts(documents: DataFrame, model: Model | None = None, confidence: bool = True, every: bool = False) -> DataFrame:
    """(doc_id, label, line_no, lang, confidence): line 0 with the main language of each document, and its lines in other languages.

    Without ``confidence`` it is 0.  With ``every`` documents without a language have a line 0 with nulls.
    """
    model = model or fit_model(documents)
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _ranges(texts):
                places, lines, langs, sure = [], [], [], []
                for i, rows in labeller.label(texts[a:b], confidence, every):
                    for line, lang, probability in rows or [(0, None, None)]:
                        places.append(a + i)
                        lines.append(line)
                        langs.append(None if lang is None else LANGUAGES[lang])
                        sure.append(probability)
                at = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("label").take(at), pa.array(lines, pa.int32()), pa.array(langs, pa.string()), pa.array(sure, pa.float64())],
                    ["doc_id", "label", "line_no", "lang", "confidence"],
                )

    source = documents.select("doc_id", F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, label string, line_no int, lang string, confidence double")


def _ranges(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    a, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= most:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def main_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, label_ok) of each document; lang is null for those without running text."""
    parts = label_parts(documents, model, every=True).filter("line_no = 0")
    return parts.select("doc_id", "label", "lang", "confidence", label_language(F.col("label")).eqNullSafe(F.col("lang")).alias("label_ok"))


def found(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, line_no, lang): documents whose label doesn't name their main language (line 0), and lines in another language than the main one."""
    wrong = ~F.coalesce(label_language(F.col("label")) == F.col("lang"), F.lit(False))
    return label_parts(documents, model, confidence=False).filter((F.col("line_no") > 0) | wrong).select("doc_id", "line_no", "lang")
