"""Subject areas of documents.

Method: complement naive Bayes on hashed words and word pairs of statements, fitted on labelled documents and refined
by expectation-maximisation over all documents: each statement's expected subject, given its words and the mix of
subjects of its document, feeds the next weights. Which features tell of a subject at all is learnt from the company that
statements keep: the subjects of the other statements of their documents, never their own, so that phrases that stand
everywhere lose what a few labelled documents seemed to say of them. The share of a document's telling statements that are about a subject
becomes the posterior of that subject, independent of the others, through a logistic curve of each subject that is
calibrated on labelled documents the weights were not fitted on; a document has the subjects of posterior 0.5 or more.

Scale: texts are cut into statements once, their words are found and hashed by array operations over whole batches, and
the features are checkpointed; every round is one pass whose tasks combine their counts before they meet, ``FEATURES``
rows of counts a task at most. Only the combined counts and figures of labelled documents reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import materialise

BLOCK = 1 << 15
ROUNDS = 4
COMPANY_ROUNDS = 2  # after these rounds, which features tell is settled
SHARE = 0.25
INFORMATIVE = 0.4
ALPHA = 0.2
LABELLED = 20000
HELD_OUT = 6  # every sixth labelled document, by a hash, calibrates instead of training

# Frequent words that tell the language of a statement's text; features are kept apart by language.
FREQUENT = {
    "en": "the a is of to and for with that when not we in it this one are by from must be after should".split(),
    "de": "der die das ist und für von mit nach wenn nicht zu den bei ein muss neu wird vor sich im zeigt es".split(),
    "es": "el la los las es de y para con que cuando no en un una se si por falla está hay antes debe".split(),
}
LANGUAGES = list(FREQUENT)
FEATURES = BLOCK * len(LANGUAGES)
_FREQUENT = {word: k for k, words in enumerate(FREQUENT.values()) for word in words}

_CODE = re.compile(r"^\s*(?:export |import |const |let |var |interface |class |def |async |function |return |@|[A-Z_]{3,}\s*=|[{}]\s*$)", re.M)
_TRACE = re.compile(r"^\s*(?:at |File \"|Traceback|Caused by|\.\.\. \d+ more|(?:[A-Z]\w*)?(?:Error|Exception)\b[^\n]*:).*$", re.M)
_HEADING = re.compile(r"^\s*#{1,6}\s[^\n]*$|^[^\n]+\n(?:={3,}|-{3,})\s*$", re.M)
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s*)?", re.M)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|;\s+(?=[A-ZÄÖÜ])")
# a sentence without its full stop: a capitalised word within a line of small ones, where the language has small nouns
_GLUED = re.compile(r"(?<=[^\W\d_A-Z]) (?=[A-Z][a-z']+ [^\W_])")
_LAST = re.compile(r"[^\W\d_]+$")


def _sentences(line: str, small_nouns: bool) -> list[str]:
    found = _SENTENCE.split(line)
    if not small_nouns:
        return found
    out = []
    for sentence in found:
        begin = 0
        for m in _GLUED.finditer(sentence):
            word = _LAST.search(sentence, begin, m.start())
            if word and word[0] not in _FREQUENT:  # no sentence ends with an article, a preposition or a conjunction
                out.append(sentence[begin : m.start()])
                begin = m.end()
        out.append(sentence[begin:])
    return out


def _language(text: str) -> int:
    told = [_FREQUENT[word] for word in text.lower().split() if word in _FREQUENT]
    return max(range(len(LANGUAGES)), key=told.count)


def statements(text: str | None) -> list[str]:
    """Sentences, list items and definitions of a text; headings and stack traces are none."""
    if not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    small_nouns = LANGUAGES[_language(text)] != "de"
    found: list[str] = []
    if len(_CODE.findall(text)) * 6 > text.count("\n") + 1:
        for block in re.split(r"\n\s*\n", text):
            code = []
            for line in block.split("\n"):
                bare = line.strip()
                if re.match(r"(?://|#|\*|/\*)\s", bare) and line[:1] not in " \t":
                    found += [s for s in _sentences(re.sub(r"^(?://|#|\*|/\*)\s*", "", bare), small_nouns) if s]
                else:
                    code.append(line)
            code = "\n".join(code).strip()
            if code and not re.fullmatch(r"[\s{}();]*", code):
                found.append(code)
        return found
    text = _HEADING.sub("\n", _TRACE.sub("", text))
    first, _, rest = text.lstrip().partition("\n")
    if rest[:1] == "\n" and not re.search(r"[.!?:]\s*$", first) and len(first) < 80:
        text = rest
    for paragraph in re.split(r"\n\s*\n|\n(?=\s*(?:[-*+]|\d+[.)])\s)", text):
        if _ITEM.match(paragraph):
            found.append(_ITEM.sub("", paragraph, count=1))
            continue
        for line in paragraph.split("\n"):
            found += _sentences(line, small_nouns)
    return [s.strip() for s in found if s and s.strip()]


_LETTER = np.zeros(0x110000, bool)
_LOWER = np.arange(0x110000, dtype=np.uint64)
for _c in range(0x110000):
    if chr(_c).isalpha():
        _LETTER[_c] = True
        if len(chr(_c).lower()) == 1:
            _LOWER[_c] = ord(chr(_c).lower())
_PRIME = 0x9E3779B97F4A7C15  # odd, so that it has an inverse for words at any place
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SPREAD, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
CODE_POINTS = 1 << 20  # of a slice whose words are found at once, but for a longer document


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


def find_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, hash)`` of all words: runs of letters, with an apostrophe between letters, parted where camel case does.

    The hash of a word is that of its lower-case letters; it comes from running sums of letters times powers, so that no word is
    looked at on its own.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = _LETTER[points]
    inside = letter.copy()
    inside[1:-1] |= (points[1:-1] == 39) & letter[:-2] & letter[2:]
    lower = _LOWER[points]
    camel = np.zeros(len(points), bool)
    camel[1:] = (points[1:] >= 65) & (points[1:] <= 90) & letter[:-1] & (lower[:-1] == points[:-1])
    before = np.concatenate(([False], inside[:-1]))
    begin = np.flatnonzero(inside & (~before | camel))
    stop = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~stop | np.concatenate((camel[1:], [False])))) + 1
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((lower + np.uint64(1)) * _powers(_PRIME, len(points)), out=sums[1:])
    return begin, end, (sums[end] - sums[begin]) * _powers(_INVERSE, len(points))[begin]


def _place(hashes: np.ndarray) -> np.ndarray:
    """Place of a feature within a block: the upper bits after mixing."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _SPREAD
    return ((mixed ^ (mixed >> np.uint64(32))) * _SPREAD >> np.uint64(49)).astype(np.int64)


_VOTES = {int(find_words(word)[2][0]): k for word, k in _FREQUENT.items()}
_VOTE_HASHES = np.array(sorted(_VOTES), np.uint64)
_VOTE_OF = np.array([_VOTES[int(h)] for h in _VOTE_HASHES])


def features(each: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(tokens, sizes, documents)`` of the statements of many documents.

    ``tokens`` are the places of words and of pairs of neighbouring words, in the block of the document's language, statement
    by statement; ``sizes`` tells how many each statement has and ``documents`` how many statements each document. Statements
    without words are left out.
    """
    of_statement = np.repeat(np.arange(len(each)), [len(s) for s in each])
    begin, _, hashes = find_words("\0".join([s for document in each for s in document]))
    ends = np.cumsum([len(s) + 1 for document in each for s in document])
    statement = np.searchsorted(ends, begin, "right")
    document = of_statement[statement] if len(of_statement) else statement
    at = np.minimum(np.searchsorted(_VOTE_HASHES, hashes), len(_VOTE_HASHES) - 1)
    voting = _VOTE_HASHES[at] == hashes
    votes = np.bincount(document[voting] * len(LANGUAGES) + _VOTE_OF[at[voting]], minlength=len(each) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    base = votes.argmax(1) * BLOCK if len(each) else np.zeros(0, np.int64)
    paired = statement[1:] == statement[:-1]
    pairs = (hashes[:-1] * _SECOND + hashes[1:])[paired]
    owner = np.concatenate((statement, statement[:-1][paired]))
    places = np.concatenate((_place(hashes) + base[document], _place(pairs) + base[document[:-1][paired]]))
    order = np.argsort(owner, kind="stable")
    used, sizes = np.unique(owner, return_counts=True)
    return places[order].astype(np.int32), sizes, np.bincount(of_statement[used], minlength=len(each)) if len(used) else np.zeros(len(each), np.int64)


def prepare(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(doc_id, tokens, sizes)``: the features of all statements in a row, and how many each has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                last, points = at, 0
                while last < len(texts) and (last == at or points + len(texts[last] or "") <= CODE_POINTS):
                    points += len(texts[last] or "")
                    last += 1
                tokens, sizes, held = features([statements(t) for t in texts[at:last]])
                parts = np.concatenate(([0], np.cumsum(held)))
                ends = np.concatenate(([0], np.cumsum(sizes)))[parts]
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.astype(np.int32))) for cut, values in ((ends, tokens), (parts, sizes))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, last - at), *lists], ["doc_id", "tokens", "sizes"])
                at = last

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens array<int>, sizes array<int>")


def _even(counts: np.ndarray) -> np.ndarray:
    """Counts as if all subjects were of one size within each language."""
    even = np.zeros_like(counts)
    for k in range(len(LANGUAGES)):
        block = slice(k * BLOCK, (k + 1) * BLOCK)
        per_subject = counts[block].sum(0)
        even[block] = counts[block] / np.maximum(per_subject, 1.0) * per_subject.mean()
    return even


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes scores of each feature and subject."""
    even, weight = _even(counts), np.zeros_like(counts)
    for k in range(len(LANGUAGES)):
        block = slice(k * BLOCK, (k + 1) * BLOCK)
        rest = even[block].sum(1, keepdims=True) - even[block] + ALPHA
        weight[block] = -np.log(rest / rest.sum(0))
    weight -= weight.mean(1, keepdims=True)
    return weight.astype(np.float32)


def telling_of(counts: np.ndarray) -> np.ndarray:
    """How much each feature tells of any subject: the greatest share of one subject among its company."""
    even = _even(counts)
    return ((even + ALPHA).max(1) / (even.sum(1) + ALPHA * counts.shape[1])).astype(np.float32)


def expect(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, weight: np.ndarray, telling: np.ndarray, fixed: list | None = None):
    """Posterior of each statement: ``(posteriors, about, document of each statement)``.

    ``flat`` are the features of all statements, ``lengths`` how many each has, ``counts`` how many statements each document.
    """
    n_docs, kinds = len(counts), weight.shape[1]
    if not len(lengths):
        return np.zeros((0, kinds), np.float32), np.zeros(0, bool), np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    tell = telling[flat]
    about = np.maximum.reduceat(tell, begin) >= INFORMATIVE
    useful = np.flatnonzero(tell >= INFORMATIVE * 0.6)  # the others are many and add nothing
    edges = np.searchsorted(useful, np.append(begin, len(flat)))
    scores = np.zeros((len(lengths), kinds), np.float32)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    if len(some):
        scores[some] = np.add.reduceat(weight[flat[useful]], edges[some])
    doc = np.repeat(np.arange(n_docs), counts)
    prior = np.zeros((n_docs, kinds), np.float32)
    if fixed is not None:
        for i, allowed in enumerate(fixed):
            if allowed is not None:
                prior[i] = -8.0
                prior[i, allowed] = 0.0
    mix = prior
    told = np.flatnonzero(about)
    filled = np.flatnonzero(np.bincount(doc[told], minlength=n_docs))
    first = np.searchsorted(doc[told], filled)
    for _ in range(3):
        logits = scores + mix[doc]
        logits -= logits.max(1, keepdims=True)
        post = np.exp(logits)
        post /= post.sum(1, keepdims=True)
        held = np.zeros((n_docs, kinds), np.float32)
        if len(told):
            held[filled] = np.add.reduceat(post[told], first)
        mix = prior + np.log((held + 0.3) / (held.sum(1, keepdims=True) + 0.3 * kinds))
    return post, about, doc


def _spread(flat: np.ndarray, lengths: np.ndarray, values: np.ndarray, least: float) -> np.ndarray:
    """Sums, at each feature, of the values of the statements it stands in; values under ``least`` do not count."""
    kinds = values.shape[1]
    statement, subject = np.nonzero(values > least)
    sizes = lengths[statement]
    begin = (np.cumsum(lengths) - lengths)[statement]
    of = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.bincount(flat[of] * kinds + np.repeat(subject, sizes), np.repeat(values[statement, subject], sizes), FEATURES * kinds).reshape(FEATURES, kinds)


def partial_counts(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, weight: np.ndarray, telling: np.ndarray, fixed: list | None = None, company: bool = False) -> np.ndarray:
    """Expected occurrences of each feature in statements about each subject; with ``company``, beside those about the others.

    The result has a column for each subject, and with ``company`` as many again.
    """
    kinds = weight.shape[1]
    if not len(lengths):
        return np.zeros((FEATURES, kinds * (1 + company)))
    post, about, doc = expect(flat, lengths, counts, weight, telling, fixed)
    own = post * about[:, None]
    found = _spread(flat, lengths, own, 1e-4)
    if not company:
        return found
    ends = np.concatenate((np.zeros((1, kinds)), np.cumsum(own, 0, dtype=np.float64)))
    parts = np.concatenate(([0], np.cumsum(counts)))
    others = np.maximum((ends[parts[1:]] - ends[parts[:-1]])[doc] - own, 0)
    size = others.sum(1, keepdims=True)
    return np.concatenate((found, _spread(flat, lengths, np.where(size > 0.5, others / np.maximum(size, 0.5), 0), 0.02)), 1)


TOKENS = 400_000  # features of a slice that is scored at once, but for a longer document


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in parts ``(first row, rows, features, sizes, statements)`` of bounded size."""
    tokens, sizes = batch.column("tokens"), batch.column("sizes")
    ends, parts = tokens.offsets.to_numpy().astype(np.int64), sizes.offsets.to_numpy().astype(np.int64)
    flat, lengths = tokens.values.to_numpy(), sizes.values.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
        yield at, last - at, flat[ends[at] : ends[last]], lengths[parts[at] : parts[last]], np.diff(parts[at : last + 1])
        at = last


def _collect_counts(rows: DataFrame, kinds: int) -> np.ndarray:
    counts = np.zeros((FEATURES, kinds))
    for place, values in rows.groupBy("place").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(kinds)]).alias("c")).toPandas().itertuples(index=False):
        counts[place] = values
    return counts


def labelled_documents(labels: DataFrame, names: list[str]) -> DataFrame:
    """``(doc_id, subjects, held_out)`` of at most ``LABELLED`` labelled documents, drawn by a hash."""
    return (
        labels.where(F.col("subject").isin(names)).select("doc_id", "subject").distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        .withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0)
    )


def _first_counts(marked: DataFrame, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the labelled documents: which statement of a document with two labels is about which, and what each feature tells.

    Runs beside the texts: each task adds up its documents, and only counts come back. What a feature tells is counted once a
    document, however often it stands there. The documents that are held out do not count.
    """
    kinds = len(number)
    training = marked.where("NOT held_out").select("tokens", "sizes", "subjects")

    def passes(weights: tuple | None) -> np.ndarray:
        shared = marked.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, kinds if shared.value is not None else 2 * kinds))
            for batch in batches:
                subjects = [[number[x] for x in row] for row in batch.column("subjects").to_pylist()]
                for first, rows, flat, lengths, counts in slices(batch):
                    fixed = subjects[first : first + rows]
                    if shared.value is not None:
                        total += partial_counts(flat, lengths, counts, *shared.value, fixed)
                        continue
                    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
                    for allowed, a, b in zip(fixed, ends, ends[1:]):
                        once = np.unique(flat[a:b])
                        for c in allowed:
                            np.add.at(total[:, c], flat[a:b], 1.0 / len(allowed))
                            total[once, kinds + c] += 1.0 / len(allowed)
            yield _counts_batch(total)

        return _collect_counts(training.mapInArrow(run, "place int, c array<float>"), kinds if weights is not None else 2 * kinds)

    both = passes(None)
    counts = own = both[:, :kinds]
    for _ in range(2):
        own = passes((weights_of(own), telling_of(both[:, kinds:]))) + 0.05 * counts
    return own, both[:, kinds:]


def _counts_batch(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total.sum(1) > 1e-6)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[used].astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], ["place", "c"])


def fit(prepared: DataFrame, marked: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after the labelled fit and ``ROUNDS`` rounds over all documents; ``marked`` are the labelled ones with their features."""
    kinds = len(names)
    own, told = _first_counts(marked, {s: i for i, s in enumerate(names)})
    weight, telling = weights_of(own), telling_of(told)
    for k in range(ROUNDS):
        shared, company = prepared.sparkSession.sparkContext.broadcast((weight, telling)), k < COMPANY_ROUNDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared, company=company) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, kinds * (1 + company)))
            for batch in batches:
                for _, _, flat, lengths, counts in slices(batch):
                    total += partial_counts(flat, lengths, counts, *shared.value, company=company)
            yield _counts_batch(total)

        found = _collect_counts(prepared.select("tokens", "sizes").mapInArrow(run, "place int, c array<float>"), kinds * (1 + company))
        weight = weights_of(own + found[:, :kinds])
        if company:
            telling = telling_of(told + found[:, kinds:])
    return weight, telling


def shares(prepared: DataFrame, weight: np.ndarray, telling: np.ndarray, names: list[str]) -> DataFrame:
    """``(doc_id, subject, share)``: the part of a document's telling statements that are about the subject."""
    shared = prepared.sparkSession.sparkContext.broadcast((weight, telling))
    kinds = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(names)
        for batch in batches:
            for first, rows, flat, lengths, counts in slices(batch):
                post, about, doc = expect(flat, lengths, counts, *shared.value)
                table = np.bincount(doc[about] * kinds + post[about].argmax(1), minlength=rows * kinds).reshape(rows, kinds) if len(doc) else np.zeros((rows, kinds))
                table = table / np.maximum(table.sum(1, keepdims=True), 1)
                row, column = np.nonzero(table)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows).take(pa.array(row)), words.take(pa.array(column)), pa.array(table[row, column])], ["doc_id", "subject", "share"])

    return prepared.mapInArrow(run, f"doc_id {prepared.schema['doc_id'].dataType.simpleString()}, subject string, share double")


def calibrate(share: np.ndarray, has: np.ndarray, subject: np.ndarray, kinds: int, *, pull: float = 60.0) -> np.ndarray:
    """``[kinds, 2]`` slope and middle of each subject's logistic curve from a share to the posterior.

    Labels lapse: some documents of a great share lack the label, some of no share have it; both rates are read off the pairs and
    the curve runs between them. The likeliest curve of a grid around the rule's quarter is taken, for each subject with the pairs
    of all subjects weighing as much as ``pull`` of its own.
    """
    slopes, middles = np.geomspace(8, 120, 12), np.linspace(0.8, 1.2, 17) * SHARE
    if len(share) < 20:
        return np.tile([40.0, 0.98 * SHARE], (kinds, 1))
    high, low = share >= 2 * SHARE, share < SHARE / 4
    missed = float(np.clip(1 - has[high].mean(), 0.01, 0.4)) if high.any() else 0.05
    wrong = float(np.clip(has[low].mean(), 0.001, 0.2)) if low.any() else 0.01
    curve = 1 / (1 + np.exp(-np.clip(slopes[:, None, None] * (share - middles[None, :, None]), -30, 30)))
    p = wrong + (1 - wrong - missed) * curve
    each = np.where(has > 0.5, np.log(p), np.log(1 - p))
    common = each.sum(2) * min(1.0, pull / len(share))
    found = []
    for k in range(kinds):
        total = common + each[:, :, subject == k].sum(2)
        near = -0.5 * (np.log(middles / (0.98 * SHARE)) / 0.05)[None] ** 2  # the rule's quarter, itself included, unless the pairs speak against it
        a, b = np.unravel_index((total + near).argmax(), total.shape)
        found.append((slopes[a], middles[b]))
    return np.array(found)


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, subject, share, posterior)``: one row per subject that a document has.

    Null, empty and blank texts, and texts that tell of no subject, have no row. A repeated row gets repeated rows of
    the same subjects removed; labels of unknown subjects or documents are ignored; without labels or subjects the
    result is empty. Columns other than those named are not read; texts are read whole.
    """
    names = sorted(r[0] for r in areas.where("subject IS NOT NULL").select("subject").distinct().collect())
    empty = f"doc_id {docs.schema[id].dataType.simpleString()}, subject string, share double, posterior double"
    if not names or labels.isEmpty():
        return docs.sparkSession.createDataFrame([], empty)
    prepared = materialise(prepare(docs, id, text))
    chosen = labelled_documents(labels, names)
    marked = materialise(prepared.join(F.broadcast(chosen), "doc_id"))
    weight, telling = fit(prepared, marked, names)
    # every subject of every held-out document, those without a share included
    told = shares(marked.where("held_out").select("doc_id", "tokens", "sizes"), weight, telling, names).dropDuplicates(["doc_id", "subject"])
    asked = marked.where("held_out").select("doc_id", "subjects").dropDuplicates(["doc_id"]).select("doc_id", "subjects", F.explode(F.array(*map(F.lit, names))).alias("subject"))
    pairs = asked.join(told, ["doc_id", "subject"], "left").select("subject", F.coalesce("share", F.lit(0.0)).alias("share"), F.array_contains("subjects", F.col("subject")).cast("double").alias("has")).toPandas()
    curves = calibrate(pairs["share"].to_numpy(), pairs["has"].to_numpy(), pairs["subject"].map({s: k for k, s in enumerate(names)}).to_numpy(), len(names))
    slope, middle = (F.create_map(*[F.lit(x) for s, c in zip(names, curves[:, k].tolist()) for x in (s, c)])[F.col("subject")] for k in (0, 1))
    return (
        shares(prepared, weight, telling, names)
        .withColumn("posterior", 1 / (1 + F.exp(-slope * (F.col("share") - middle))))
        .where(F.col("posterior") >= 0.5 - 1e-9)
        .dropDuplicates(["doc_id", "subject"])
    )


def composition(subjects: DataFrame) -> DataFrame:
    """Documents and mean share per subject."""
    return subjects.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))
