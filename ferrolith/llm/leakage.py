"""Evaluation texts leaking into training text: a generalised suffix automaton over the test items.

The words of all items, folded so that case, accents and commonly misread letters don't count, make one generalised
suffix automaton. Each document is streamed through it word by word: the automaton's state gives the longest run of words
that ends here and occurs in some item, and every run that can't be made longer gives, by the end positions of its state,
the items and places it matches. Runs are chained per item in order of item and document, with any other text between
them; the gaps between neighbouring runs of a chain are compared word by word. A stretch of the item that begins and ends
on matched words is a leak if it has at least `least` words, at least `share` of them matched, these stand together but for a
few insertions, and at least `own_share` of its own words are matched: those whose pairs with the word before and the word after are in no other item. What is altered in
a leak are any words; in sentences made after the same pattern it is just the own words, names and numbers. `least` words
verbatim are a leak whatever the item's own words, and of every item that has them; so are LONG words nearly verbatim where
the item has no own word.

The automaton is built once by each Python worker from the items, which are sent as one broadcast of checked size
(ITEMS_BYTES, some 400,000 states); beyond that the items are handled in blocks, one pass over the documents for each block. The
end positions of a state are a slice of one list in the order of the suffix links, so that none is held twice. What is rare and what is an item's own is
counted over all items, so that it doesn't depend on where the blocks are cut. With few items no word can weigh much: the
least weights of anchors and stretches are lowered with the greatest weight there is (below FULL).

Defined results: null and empty documents and items match nothing; the longest texts are streamed whole; repeated items
(the same text under two ids) count as one text and are all reported; `cleaned` takes the spans out of the text as it was read
(composed, words broken at line ends joined), with the order of what is left kept, and leaves other documents as they are.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import unscramble
from ferrolith.session import checkpoint

LEAST = 15  # words of a stretch
SHARE = 0.76  # of its words matched
OWN_SHARE, OWN_SHORT, OWN_LEAST = 0.5, 0.55, 3  # of the item's own words in it matched: in long ones, below LONG words, and how many at least
NEARLY = 0.93  # with as many words matched two own words do, and one where nothing is altered
LONG = 30
LOOSE = 0.5  # other text stands in one place, and in one more for each LONG words; all else between the matched words is at most this share of their number
OWN = 0.0  # a pair of words in more of the items than this share (or than one) belongs to a pattern
ANCHOR = 2.5  # a run of less weight is no anchor of its own; it counts where it lies between anchors
HEAVY = 9.0  # a stretch of 15 words with a fifth altered has anchors of at least this weight
FULL = 2.0  # greatest weight of a word from which the least weights hold as they are
ITEMS_BYTES = 2_000_000
WHOLE = 0.5  # share of a document in leaking spans from which on nothing of it is kept

# Letters that are read for each other, each written as the first of its set.
_READ = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "h": "b", "6": "b", "c": "e", "q": "g", "9": "g", "ı": "l", "u": "n", "v": "y"})
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile("(\\w)[-­‐]\\s*\\n\\s*(?=\\w)")


def _key(word: str) -> str:
    return word.translate(_READ).replace("rn", "m").replace("cl", "d").replace("el", "d")


_KEYS: dict[str, str] = {}


def prepared(text: str) -> str:
    """A text as its words are found in it: composed, words broken at line ends joined."""
    t = unscramble(text)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).replace("­", "")
    if "-" in t or "‐" in t:
        t = _BROKEN.sub(r"\1", t)
    return t


def folded(text: str) -> list[str]:
    """Folded words of a text; each different word is folded once (the memory of words is emptied when it gets large)."""
    t = prepared(text)
    if len(_KEYS) > 500_000:
        _KEYS.clear()
    out = []
    for w in map(str.lower, _WORD.findall(t)):  # word by word, so that words keep their places in t
        k = _KEYS.get(w)
        if k is None:
            plain = w if w.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", w) if not unicodedata.combining(ch))
            k = _KEYS[w] = _key(plain)
        out.append(k)
    return out


class Automaton:
    """Generalised suffix automaton over lists of words."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, text in enumerate(texts):
            last = 0
            for i, w in enumerate(text):
                last = self._extend(last, w)
                own[last].append((k, i))
        # the states in the order of the tree of suffix links: the ends of a state and of all below it stand together
        below: dict[int, list[int]] = defaultdict(list)
        for s in range(1, len(self.link)):
            below[self.link[s]].append(s)
        self._ends: list[tuple[int, int]] = []
        self._from, self._to = [0] * len(self.len), [0] * len(self.len)
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                self._to[s] = len(self._ends)
                continue
            self._from[s] = len(self._ends)
            self._ends += own.pop(s, ())
            stack.append((s, True))
            stack += [(c, False) for c in below.pop(s, ())]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(text, place) of every occurrence of the state's words, by their last word."""
        return self._ends[self._from[state] : self._to[state]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: str) -> int:
        c = self._new(self.len[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[last] + 1 == self.len[q] else self._clone(last, q, w)
        cur = self._new(self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[p] + 1 == self.len[q] else self._clone(p, q, w)
        return cur

    def runs(self, text: list[str], least: float = math.inf, long: dict[int, tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int]]:
        """(state, length, end) of each run of the text that occurs in some item and can't be made longer at its end.

        long gets, for each state reached with `least` words or more, the greatest length and its end.
        """
        state = length = 0
        nxt, link, size = self.next, self.link, self.len
        for j, w in enumerate(text):
            to = nxt[state].get(w)
            if to is None:
                if length:
                    yield state, length, j - 1
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    length = 0
                    continue
                length = size[state] + 1
            else:
                length += 1
            state = to
            if length >= least and (state not in long or long[state][0] < length):
                long[state] = length, j
        if length:
            yield state, length, len(text) - 1


def _same(a: str, b: str) -> bool:
    """Equal but for one letter in ten, or one; numbers must be equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or not (a.isalpha() and b.isalpha()):
        return False
    most = max(1, max(len(a), len(b)) // 10)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            up, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, up + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def distinct(items: Iterable[tuple[int, str]]) -> list[tuple[list[int], str]]:
    """Each text once, as folded, with the ids that have it."""
    by: dict[tuple[str, ...], tuple[list[int], str]] = {}
    for i, t in items:
        ids = by.setdefault(tuple(folded(t)), ([], t))[0]
        if i not in ids[-1:]:
            ids.append(i)
    return list(by.values())


Counts = tuple[int, dict[str, int], dict[tuple[str, str], int]]


def counted(texts: Iterable[list[str]]) -> Counts:
    """Number of folded texts, and in how many of them each word and each pair of neighbouring words is."""
    n, words, pairs = 0, Counter(), Counter()
    for x in texts:
        n += 1
        words.update(set(x))
        pairs.update(set(zip(x, x[1:])))
    return n, words, pairs


def _of(counts: Counts, texts: Iterable[list[str]]) -> Counts:
    """What of the counts concerns these texts."""
    n, words, pairs = counts
    held = list(texts)
    return n, {w: words[w] for x in held for w in x}, {p: pairs[p] for x in held for p in zip(x, x[1:])}


class Matcher:
    """Of texts that are `distinct`; counts: those of all items, where these are but a block of them."""

    def __init__(self, items: list[tuple[list[int], str]], least: int = LEAST, share: float = SHARE, own_share: float = OWN_SHARE, own: float = OWN, counts: Counts | None = None):
        self.ids = [i for i, _ in items]
        self.items = [folded(t) for _, t in items]
        self.least, self.share, self.own_share = least, share, own_share
        total, df, pairs = counts or counted(self.items)
        self.weight = {w: math.log((total + 1) / n) for w, n in df.items()}
        unit = min(1.0, math.log(total + 1) / FULL)
        self.anchor, self.heavy = ANCHOR * unit, HEAVY * unit
        self.sam = Automaton(self.items)
        self.weights = [[self.weight[w] for w in x] for x in self.items]
        common = max(1, own * total)
        usual = [[pairs[p] > common for p in zip(x, x[1:])] for x in self.items]
        self.own = [[not any(u[max(0, i - 1) : i + 1]) for i in range(len(x))] for x, u in zip(self.items, usual)]
        self.bare = ["0" * LONG in "".join("1" if o else "0" for o in x) for x in self.own]

    def stretches(self, text: list[str]) -> dict[int, tuple[int, int, int]]:
        """item index -> (words, from, to) of its longest leaking stretch in the text."""
        get = self.weight.get
        w_at = [get(x, 0.0) for x in text]
        # the anchors of a stretch weigh `heavy`, overlaps cut in proportion; without half as much in the whole text there is none,
        # but for what is verbatim: `least` words of items in a row
        if sum(w_at) < self.heavy / 2 and "1" * self.least not in "".join(["1" if x in self.weight else "0" for x in text]):
            return {}
        upto = [0.0, *itertools.accumulate(w_at)]
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        total: dict[int, float] = defaultdict(float)
        long: dict[int, tuple[int, int]] = {}
        for state, length, end in self.sam.runs(text, self.least, long):
            start = end - length + 1
            w = upto[end + 1] - upto[start]
            if w < self.anchor:
                continue
            for k, e in self.sam.ends(state):
                anchors[k].append((e - length + 1, start, length))
                total[k] += w
        out = {}
        for k, w in total.items():
            if w >= self.heavy and (best := self._best(k, anchors[k], text)):
                out[k] = best
        for k, best in self._verbatim(long).items():
            if k not in out or out[k][0] < best[0]:
                out[k] = best
        return out

    def _verbatim(self, long: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """item index -> its longest stretch of `least` words or more that the text has verbatim; also inside longer ones of other items."""
        link, size = self.sam.link, self.sam.len
        runs = dict(long)
        for s, (_, end) in long.items():
            while (s := link[s]) > 0 and size[s] >= self.least and (s not in runs or runs[s][0] < size[s]):
                runs[s] = size[s], end
        out: dict[int, tuple[int, int, int]] = {}
        for s, (n, end) in runs.items():
            for k in {k for k, _ in self.sam.ends(s)}:
                if k not in out or out[k][0] < n:
                    out[k] = n, end - n + 1, end
        return out

    def _best(self, k: int, anchors: list[tuple[int, int, int]], text: list[str]) -> tuple[int, int, int] | None:
        item, weights, own = self.items[k], self.weights[k], self.own[k]
        # a leak has own words that are unaltered and weigh enough to be anchors themselves: two, or one in a long run
        # none where the item has none to a length of LONG
        seen = len({x for i, _, n in anchors for x in range(i, i + n) if own[x]})
        if not self.bare[k] and (seen < 1 or (seen < 2 and max(a[2] for a in anchors) < 7)):
            return None
        anchors = sorted(set(anchors), key=lambda a: (a[1], a[0]))
        value = [sum(weights[a[0] : a[0] + a[2]]) for a in anchors]
        best, back = list(value), [-1] * len(anchors)
        for x, (i, j, n) in enumerate(anchors):
            for y in range(x - 1, -1, -1):
                a, b, m = anchors[y]
                cut = max(0, a + m - i, b + m - j)
                if a < i and b < j and cut < n:
                    v = best[y] + value[x] * (n - cut) / n - min(4.0, (j - b - m) / 100)
                    if v > best[x]:
                        best[x], back[x] = v, y
        x = max(range(len(anchors)), key=best.__getitem__)
        if best[x] < self.heavy:
            return None
        chain = []
        while x >= 0:
            chain.append(anchors[x])
            x = back[x]
        chain.reverse()
        if not self.bare[k] and not any(own[x] for i, _, n in chain for x in range(i, i + n)):
            return None
        hit = [False] * len(item)
        where: dict[int, int] = {}
        pi = pj = None
        for i, j, n in chain:
            if pi is not None:
                self._fill(item, text, pi, i, pj, j, hit, where)
            for d in range(n):
                hit[i + d] = True
                where[i + d] = j + d
            pi, pj = i + n, j + n
        i, j, _ = chain[0]
        self._fill(item, text, max(0, i - 6), i, max(0, j - 7), j, hit, where)
        self._fill(item, text, pi, min(len(item), pi + 6), pj, min(len(text), pj + 7), hit, where)
        at = [i for i, h in enumerate(hit) if h]
        sums, owns, own_hits = [0], [0], [0]
        for i, h in enumerate(hit):
            sums.append(sums[-1] + h)
            owns.append(owns[-1] + own[i])
            own_hits.append(own_hits[-1] + (h and own[i]))
        top = None
        for a in at:
            for b in reversed(at):
                n = b - a + 1
                if n < self.least or (top and n <= top[0]):
                    break
                need = max(self.own_share, OWN_SHORT if n < LONG else 0.0) * (owns[b + 1] - owns[a])
                got = sums[b + 1] - sums[a]
                least = 1 if got == n == where[b] - where[a] + 1 else 2 if got >= NEARLY * n else OWN_LEAST
                if got >= NEARLY * n and n >= LONG and owns[b + 1] == owns[a]:
                    least = 0
                if got >= self.share * n and own_hits[b + 1] - own_hits[a] >= max(least, need) and self._close([where[i] for i in range(a, b + 1) if hit[i]]):
                    top = (n, where[a], where[b])
                    break
        return top

    @staticmethod
    def _close(at: list[int]) -> bool:
        """Whether matched words stand together but for a few insertions."""
        at = sorted(at)
        between = sorted(b - a - 1 for a, b in zip(at, at[1:]))
        return sum(between[: -1 - len(at) // LONG]) <= LOOSE * len(at)

    @staticmethod
    def _fill(item: list[str], text: list[str], i0: int, i1: int, j0: int, j1: int, hit: list[bool], where: dict[int, int]) -> None:
        """Words of the item between two matched runs that the text has in the gap, altered at most a little."""
        if i1 <= i0 or j1 <= j0:
            return
        a = item[i0:i1]
        b, base = text[j0:j1], j0
        if len(b) > 3 * len(a) + 12:  # other text was put in: only its ends can belong to the item
            n = len(a) + 6
            for part, base in ((text[j0 : j0 + n], j0), (text[j1 - n : j1], j1 - n)):
                Matcher._align(a, part, i0, base, hit, where)
            return
        Matcher._align(a, b, i0, base, hit, where)
        rest = [x for x in range(len(a)) if not hit[i0 + x]]
        if rest and len(b) <= len(a) + 3 and _same("".join(a), "".join(b)):
            for x in rest:
                hit[i0 + x] = True
                where[i0 + x] = base

    @staticmethod
    def _align(a: list[str], b: list[str], i0: int, base: int, hit: list[bool], where: dict[int, int]) -> None:
        n, m = len(a), len(b)
        eq = [[_same(x, y) for y in b] for x in a]
        score = [[0] * (m + 1) for _ in range(n + 1)]
        for x in range(n - 1, -1, -1):
            for y in range(m - 1, -1, -1):
                score[x][y] = max(score[x + 1][y], score[x][y + 1], score[x + 1][y + 1] + 1 if eq[x][y] else 0)
        x = y = 0
        while x < n and y < m:
            if eq[x][y] and score[x][y] == score[x + 1][y + 1] + 1:
                if not hit[i0 + x]:
                    hit[i0 + x] = True
                    where[i0 + x] = base + y
                x, y = x + 1, y + 1
            elif score[x + 1][y] >= score[x][y + 1]:
                x += 1
            else:
                y += 1


def _texts(items: DataFrame) -> DataFrame:
    """ids, text of each different text of the items, as folded."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(folded(t)))

    rows = items.filter("text is not null and item_id is not null").select("item_id", "text", F.pandas_udf(fold, "string")("text").alias("f"))
    return rows.groupBy("f").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.min("text").alias("text")).orderBy(F.col("ids")[0], "text").select("ids", "text")


def _blocks(texts: DataFrame) -> Iterator[list[tuple[list[int], str]]]:
    """The texts in blocks of at most ITEMS_BYTES, one held at a time."""
    block: list[tuple[list[int], str]] = []
    held = 0
    for r in texts.toLocalIterator():
        n = len(r["text"].encode()) + 8 * len(r["ids"])
        if held + n > ITEMS_BYTES and block:
            yield block
            block, held = [], 0
        block.append((list(r["ids"]), r["text"]))
        held += n
    if block:
        yield block


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, held) -> Matcher:
    """The matcher of a block, built once by a worker; the blocks before it are forgotten."""
    if name not in _MATCHERS:
        block, limits = held.value
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(block, **limits)
    return _MATCHERS[name]


def leaks(documents: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """item_id, doc_id, words (of the item's longest leaking stretch), first_word, last_word (its place in the document)."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("text is not null and doc_id is not null")
    out = spark.createDataFrame([], "item_id long, doc_id long, words int, first_word int, last_word int")
    texts = checkpoint(_texts(items))
    # counts over all items, which are a stated set: words and pairs of the evaluation texts
    counts = counted(folded(t) for b in _blocks(texts) for _, t in b)
    for number, block in enumerate(_blocks(texts)):
        held = spark.sparkContext.broadcast((block, limits | {"counts": _of(counts, (folded(t) for _, t in block))}))
        name = f"{held._jbroadcast.id()}-{number}"

        def run(parts: Iterator[pd.DataFrame], held=held, name=name) -> Iterator[pd.DataFrame]:
            m = _matcher(name, held)
            for p in parts:
                rows = []
                for d, t in zip(p["doc_id"], p["text"]):
                    for k, (n, a, b) in m.stretches(folded(t)).items():
                        rows.extend((i, d, n, a, b) for i in m.ids[k])
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "words", "first_word", "last_word"])

        out = out.unionByName(docs.mapInPandas(run, "item_id long, doc_id long, words int, first_word int, last_word int"))
    return out


def without(text: str, spans: Iterable[tuple[int, int]]) -> tuple[str, int]:
    """The text as prepared() gives it without the words of the spans (first and last, as in leaks), and the number of words taken out."""
    t = prepared(text)
    at = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    out, end, gone = [], 0, set()
    for a, b in sorted(spans):
        gone.update(range(a, b + 1))
        if at[b][1] <= end:
            continue
        out.append(t[end : max(end, at[a][0])])
        end = at[b][1]
    out.append(t[end:])
    return " ".join(x.strip() for x in out if x.strip()), len(gone)


def cleaned(documents: DataFrame, items: DataFrame, whole: float = WHOLE, **limits) -> DataFrame:
    """doc_id, text, removed of every document: leaking spans taken out, `removed` words of them; text is null where they cover `whole` of the words or more."""
    spans = leaks(documents, items, **limits).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first_word", "last_word"))).alias("spans"))
    x = documents.select("doc_id", "text").join(spans, "doc_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, removed = [], []
            for t, s in zip(p["text"], p["spans"]):
                if s is None or t is None:
                    texts.append(t)
                    removed.append(0)
                    continue
                rest, n = without(t, [(y["first_word"], y["last_word"]) for y in s])
                texts.append(rest if n < whole * len(_WORD.findall(prepared(t))) else None)
                removed.append(n)
            yield pd.DataFrame({"doc_id": p["doc_id"], "text": pd.Series(texts, index=p.index, dtype=object), "removed": removed})

    return x.mapInPandas(run, "doc_id long, text string, removed int")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("item_id", "doc_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item: documents that hold a passage of it and the longest stretch; items that leaked nowhere have 0."""
    x = leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    return items.select("item_id", "task").join(x, "item_id", "left").fillna(0, ["documents", "longest"])
