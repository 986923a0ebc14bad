"""HTML extraction by equivalence-class template deduction.

Pages of one host come from templates.  A token is a tag or a word together
with the path of open elements around it.  Its occurrence vector holds how often
it occurs on each of the host's pages; tokens with the same vector form an
equivalence class (Arasu and Garcia-Molina, 2003).

* Classes whose tokens occur once on a page make the root of the template, in the
  order of the longest skeleton that a twentieth of the pages has.  They need not
  be on every page: a page that lacks a part has the other parts' slots.
* The other classes nest, in the gaps of the root and of one another: a class is
  valid if its tokens follow one another in one order and all its occurrences lie
  in one gap of the root, and in one gap of every valid class that it is inside
  of.  ``tolerance`` of the pages (of the occurrences) may differ.
* A host may have several templates: a page with less than half of the tokens that
  most pages have once (an error page, a listing) is set aside, and the pages set
  aside have their own template deduced the same way, up to ``max_templates``.

What no template token covers are the slots, which hold a page's content.

Vectors are never built: pages are hashed and a vector is represented by the sum
of its entries' hashes, so classes come from one aggregation that no hot host
can overload.  Which tokens are frequent enough is found by partitioning (Savasere
et al., 1995): a token with the support on all the host's pages has it on the
pages of at least one chunk, so the chunks' frequent tokens are all that has to
be counted exactly.  HTML is parsed three times and never shuffled: for candidate
tokens, for each page's sequence of candidates (written as small numbers, from
which vectors, skeletons and nesting are worked out), and to extract.  What comes
back per host is bounded by tokens per page / support, and joins the pages by
broadcast if it is small, else by a shuffled join.

Defined results
---------------
* The host is the lower-cased host part of the URL.  Pages with a null url or
  without a host, single pages and those left after ``max_templates`` have no
  template (number 0): all their text is in slot 0.  Templates are numbered from
  1.  Pages without tokens do not count as pages: null, empty or blank html.
* On fewer than ``min_word_pages`` pages words that pages have in common may be
  chance: there only tags make the template.
* Slots are (slot, field, text) in page order.  slot is the place in the root of
  the root token before it, from 1, or 0, and so is the same on all the template's
  pages, whatever they lack.  field is 0 after a root token, else the number of
  the nested token before it, so that values of repeated records line up.  Markup
  and white space are left out of a value; an empty value is no slot.
* A null or empty html has no slots.  Every row gives a row, repeated ones each;
  null page_ids pass through.  Malformed markup is read leniently.
* An empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import as_strings, attach_by_group, bounded_batches, col, column_of, expand_ranges, slices, small_enough, written

_PIECE = 4 << 20
#: Bytes of HTML whose tokens are counted together when candidates are looked for.
CHUNK_BYTES = 32 << 20
_MARKUP = re.compile(r"(<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[a-zA-Z/!?][^>]*>)", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OWN = frozenset(("p", "li", "td", "tr", "option"))
_M64 = (1 << 64) - 1
_NAMES: dict[tuple[int, str], int] = {}


def _inner(path: int, name: str) -> int:
    """The path one element further in."""
    key = (path, name)
    if key not in _NAMES:
        if len(_NAMES) > 1 << 18:
            _NAMES.clear()
        _NAMES[key] = int(tk.mix(np.array([(path * 0x9E3779B97F4A7C15 + int(tk.string_hashes(pa.array([name]))[0])) & _M64], np.uint64))[0])
    return _NAMES[key]


#: What a tag stands for, by its text: token, what it does (0 nothing, 1 opens, 2 closes) and the element's name.
_TAGS: dict[str, tuple[str, int, str]] = {}


def _tag(tag: str) -> tuple[str, int, str]:
    mark = tag[1]
    if mark == "!" or mark == "?":
        out = ("<!>", 0, "")
    elif mark == "/":
        name = tag[2:-1].strip().lower()
        out = (f"</{name}>", 2, name)
    else:
        inside = tag[1:-1].split(None, 1)
        name = inside[0].lower().rstrip("/") if inside else ""
        if name.startswith(("script>", "style>")):
            name = name.split(">")[0]
        out = (f"<{name}>", 0 if name in _VOID or name in ("script", "style") or tag[-2:-1] == "/" else 1, name)
    if len(tag) < 200:
        if len(_TAGS) > 1 << 16:
            _TAGS.clear()
        _TAGS[tag] = out
    return out


class Pages:
    """The tokens of a few pages, one page after the other."""

    def __init__(self, htmls: list[str]):
        words: list[str] = []
        paths: list[int] = []
        sizes: list[int] = []
        ends: list[int] = []
        known, add_word, add_path, add_size = _TAGS.get, words.append, paths.append, sizes.append
        for html in htmls:
            path = 0
            names: list[str] = []
            outer: list[int] = []
            markup = False
            for piece in _MARKUP.split(html):
                if not markup:
                    markup = True
                    text = piece.split()
                    if text:
                        words += text
                        add_path(path)
                        add_size(len(text))
                    continue
                markup = False
                word, what, name = known(piece) or _tag(piece)
                add_word(word)
                if what == 2:
                    if name in names:
                        while True:
                            last, path = names.pop(), outer.pop()
                            if last == name:
                                break
                elif name in _OWN and names and names[-1] == name:
                    names.pop()
                    path = outer.pop()
                add_path(path)
                add_size(1)
                if what == 1:
                    names.append(name)
                    outer.append(path)
                    path = _inner(path, name)
            ends.append(len(words))
        self.words = words
        self.bounds = np.append(0, np.array(ends, np.int64))
        d = pa.array(words, pa.large_string()).dictionary_encode()
        h = tk.string_hashes(d.dictionary)[d.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        around = np.repeat(np.array(paths, np.uint64), np.array(sizes, np.int64)) if len(words) else h
        self.tag = np.array([w[0] == "<" and w[-1] == ">" for w in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        #: 48-bit token hashes, so that a page or host number fits beside one
        self.tokens = (tk.mix(h ^ around) >> np.uint64(16)).astype(np.int64)
        self.page = np.repeat(np.arange(len(htmls)), np.diff(self.bounds))


def _host(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _rows(b: pa.RecordBatch):
    """A batch's HTML texts and hosts, and its hosts' numbers."""
    hosts = column_of(b, "h").to_pylist()
    number: dict[str, int] = {}
    own = np.array([number.setdefault(h, len(number)) for h in hosts], np.int64)
    return as_strings(column_of(b, "t")).to_pylist(), list(number), own


def _pieces(batches, size):
    """Slices that also have few enough rows for a page number of 14 bits."""
    for b in slices(batches, "t", size):
        for i in range(0, b.num_rows, 1 << 14):
            yield b.slice(i, 1 << 14)


#: A host's list: hashes of tokens, whether they are tags, and common ones; with a template, their class, order, class size and field.
_COMMON = T.StructType([T.StructField("k", T.LongType()), T.StructField("tag", T.BooleanType()), T.StructField("common", T.BooleanType())])
_MEMBERS = T.StructType([*_COMMON.fields, *[T.StructField(x, T.IntegerType()) for x in "cozf"]])


def _candidates(batches, support: float):
    """(host, token, tag, pages with it once) of tokens frequent on the host's pages within some chunk."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    pages: dict[str, int] = {}
    size = 0

    def flush():
        for h, parts in found.items():
            token, once = (np.concatenate(x) for x in zip(*parts))
            token, inv, n = np.unique(token, return_inverse=True, return_counts=True)
            once = np.bincount(inv, once, len(token)).astype(np.int64)
            keep = n >= support * pages[h] - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array([h] * int(keep.sum()), pa.string()), pa.array(token[keep] >> 1), pa.array((token[keep] & 1).astype(bool)), pa.array(once[keep])], names=["h", "k", "tag", "once"])

    for b in _pieces(batches, _PIECE):
        htmls, hosts, own = _rows(b)
        p = Pages(htmls)
        distinct, n = np.unique((((p.tokens << 1) | p.tag) << 14) | p.page, return_counts=True)
        token, host = distinct >> 14, own[distinct & 0x3FFF]
        o = np.argsort(host, kind="stable")
        cuts = np.searchsorted(host[o], np.arange(len(hosts) + 1))
        for i, h in enumerate(hosts):
            at = o[cuts[i] : cuts[i + 1]]
            found.setdefault(h, []).append((token[at], (n[at] == 1).astype(np.int64)))
            pages[h] = pages.get(h, 0) + int((own == i).sum())
        size += sum(map(len, htmls))
        if size >= CHUNK_BYTES:
            yield from flush()
            found, pages, size = {}, {}, 0
    yield from flush()


def _known(b: pa.RecordBatch, own: np.ndarray, p: Pages):
    """Tokens of the pages that their host's list has: token numbers in p and places in the flat list; and each host's first place."""
    lists = column_of(b, "m")
    first = np.full(own.max() + 1 if len(own) else 0, -1, np.int64)
    first[own[::-1]] = np.arange(len(own))[::-1]
    off = lists.offsets.to_numpy()
    values = lists.values.field("k").to_numpy(zero_copy_only=False)
    who, place = expand_ranges(off[first], off[first + 1])
    key = (who << 48) | values[place] if len(place) else np.zeros(0, np.int64)
    o = np.argsort(key)
    key, place = key[o], place[o]
    want = (own[p.page] << 48) | p.tokens
    at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
    hit = np.flatnonzero(key[at] == want) if len(key) else np.zeros(0, np.int64)
    return hit, place[at[hit]], off[first]


def _follows(b: pa.RecordBatch, own: np.ndarray, p: Pages, hit: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each page has at least half of the tokens that most of its host's pages have once."""
    n = len(own)
    common = column_of(b, "m").values.field("common").to_numpy(zero_copy_only=False).astype(bool)
    lists = column_of(b, "m")
    off = lists.offsets.to_numpy()
    sums = np.append(0, np.cumsum(common))
    need = sums[off[1 : n + 1]] - sums[off[:n]]
    mine = common[place]
    span = max(1, len(common))
    pairs = np.unique(p.page[hit[mine]] * span + place[mine])
    return 2 * np.bincount(pairs // span, minlength=n) >= need


def _sequences(batches, arrow_id):
    """Every page's candidates as places in its host's list; a page of another template keeps its html for the next round."""
    for b in _pieces(batches, _PIECE):
        htmls, hosts, own = _rows(b)
        p = Pages(htmls)
        hit, place, first = _known(b, own, p)
        good = _follows(b, own, p, hit, place)
        page = p.page[hit]
        stay = good[page]
        seq = place[stay] - first[own[page[stay]]]
        off = np.append(0, np.cumsum(np.bincount(page[stay], minlength=len(htmls))))
        text = column_of(b, "t")
        rest = text.take(pa.array(np.arange(len(good)), mask=good))
        yield pa.RecordBatch.from_arrays(
            [column_of(b, "i").cast(arrow_id), column_of(b, "h"), pa.array(good), pa.array(tk.string_hashes(text).view(np.int64)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(seq, pa.int32())), rest], names=["i", "h", "good", "mark", "seq", "t"]
        )


def _flat(b: pa.RecordBatch):
    """A batch of sequences, flat: page and host numbers and places, host names."""
    lists = column_of(b, "seq")
    off = lists.offsets.to_numpy()
    hosts = column_of(b, "h").to_pylist()
    number: dict[str, int] = {}
    own = np.array([number.setdefault(h, len(number)) for h in hosts], np.int64)
    page = np.repeat(np.arange(b.num_rows), np.diff(off))
    return page, own, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), list(number), np.append(0, np.cumsum(np.diff(off)))


def _vectors(batches):
    """Partial sums over pages for each candidate: support, vector hash, occurrences, places."""
    for b in batches:
        page, own, idx, hosts, off = _flat(b)
        if not len(idx):
            continue
        span = int(idx.max()) + 1
        pair, first, n = np.unique(page * span + idx, return_index=True, return_counts=True)
        page, idx = pair // span, pair % span
        mark = column_of(b, "mark").to_numpy().view(np.uint64)
        entry = tk.mix(mark[page] ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        rel = (first - off[page]) / np.maximum(1, np.diff(off))[page]
        key = own[page] * span + idx
        o = np.argsort(key, kind="stable")
        key = key[o]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = lambda x: np.add.reduceat(x[o], cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array([hosts[i] for i in key[cut] // span], pa.string()), pa.array(key[cut] % span, pa.int32()), pa.array(total(np.ones(len(o), np.int64))), pa.array(total((entry & np.uint64(0xFFFFFFFF)).astype(np.int64))), pa.array(total((entry >> np.uint64(32)).astype(np.int64))), pa.array(total(n)), pa.array(total(rel))],
            names=["h", "x", "n", "lo", "hi", "m", "at"],
        )


def _members(b: pa.RecordBatch, page: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Places in the flat lists of column m of the tokens that pages have at places idx of their host's list."""
    lists = column_of(b, "m")
    return lists.offsets.to_numpy()[page] + idx


def _skeletons(batches):
    """(host, hash, sequence, pages) of the different orders of root tokens on pages."""
    for b in batches:
        page, own, idx, hosts, _ = _flat(b)
        c = column_of(b, "m").values.field("c").to_numpy(zero_copy_only=False)
        root = c[_members(b, page, idx)] == 0
        page, idx = page[root], idx[root]
        off = np.append(0, np.cumsum(np.bincount(page, minlength=b.num_rows)))
        h = tk.range_hash(tk.prefix_hash(tk.mix(idx.astype(np.uint64) + np.uint64(1))), off[:-1], off[1:]).view(np.int64)
        key, at, n = np.unique(np.stack([own, h], axis=1), axis=0, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in key[:, 0]], pa.string()), pa.array(key[:, 1]), pa.array([idx[off[i] : off[i + 1]] for i in at], pa.list_(pa.int32())), pa.array(n)], names=["h", "v", "s", "pages"])


def _checks(batches):
    """How classes lie: (host, class, token, parent class, gap, how often).

    token >= 0: a root token out of order.  parent -1: an occurrence out of the
    class's order (gap 1) or in it (gap 0).  Else: occurrences in a gap of the
    parent, the root being class 0.
    """
    for b in batches:
        page, own, idx, hosts, _ = _flat(b)
        flat = column_of(b, "m").values
        c, o, z = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "o", "z"))
        m = _members(b, page, idx)
        use = c[m] >= 0
        page, idx, m = page[use], idx[use], m[use]
        cls, order, size = c[m].astype(np.int64), o[m].astype(np.int64), z[m].astype(np.int64)
        host = own[page]
        out = []

        def emit(host, cls, token, parent, gap):
            k, n = np.unique(np.stack([host, cls, token, parent, gap], axis=1), axis=0, return_counts=True)
            out.append((k, n))

        if len(m):
            same = np.zeros(len(m), np.int64)
            root = np.flatnonzero(cls == 0)
            key = page[root] * (1 << 32) + order[root]
            wrong = root[np.maximum.accumulate(key) > key] if len(root) else root
            emit(host[wrong], cls[wrong], idx[wrong], same[wrong], same[wrong])
            rest = np.flatnonzero(cls > 0)
            by = rest[np.lexsort((rest, page[rest], cls[rest]))]
            new = np.append(True, (cls[by][1:] != cls[by][:-1]) | (page[by][1:] != page[by][:-1])) if len(by) else np.zeros(0, bool)
            rank = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
            emit(host[by], cls[by], same[by] - 1, same[by] - 1, (rank % size[by] != order[by]).astype(np.int64))
            begin = np.searchsorted(page, page)
            for d in np.unique(cls):
                last = np.maximum.accumulate(np.where(cls == d, np.arange(len(m)), -1))[rest]
                inside = last >= begin[rest]
                gap = np.where(inside, order[last] + 1, 0)
                if d:  # after its last token a class is closed
                    inside &= gap < size[last]
                    at = np.flatnonzero(inside & (cls[rest] != d))
                else:
                    at = np.arange(len(rest))
                emit(host[rest[at]], cls[rest[at]], same[at] - 1, same[at] + d, gap[at])
        k = np.concatenate([x for x, _ in out]) if out else np.zeros((0, 5), np.int64)
        n = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in k[:, 0]], pa.string()), *[pa.array(k[:, j], pa.int32()) for j in (1, 2, 3, 4)], pa.array(n, pa.int64())], names=["h", "c", "x", "d", "gap", "n"])


def _extract(batches, arrow_id, number: int, every: bool):
    """The slots of the pages that follow their host's template; of all pages, with every."""
    slot = pa.list_(pa.struct([("slot", pa.int32()), ("field", pa.int32()), ("text", pa.string())]))
    for b in _pieces(batches, _PIECE):
        htmls, hosts, own = _rows(b)
        p = Pages(htmls)
        hit, place, _ = _known(b, own, p)
        good = np.ones(len(htmls), bool) if every else _follows(b, own, p, hit, place)
        flat = column_of(b, "m").values
        c, o, f = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("c", "o", "f"))
        use = c[place] >= 0
        hit, place = hit[use], place[use]
        cls, order, field = c[place], o[place].astype(np.int64), f[place].astype(np.int64)
        # a root token that comes too late on this page is no part of its skeleton
        root = np.flatnonzero(cls == 0)
        key = p.page[hit[root]] * (1 << 32) + order[root]
        late = root[np.maximum.accumulate(key) > key] if len(root) else root
        covered = np.zeros(len(p.words), bool)
        covered[hit] = True
        covered[hit[late]] = False
        kept = np.setdiff1d(root, late)
        # of every word, the root token before it and the template token before it
        before = np.searchsorted(hit[kept], np.arange(len(p.words)), "right") - 1
        here = (before >= 0) & (hit[kept][np.maximum(before, 0)] >= p.bounds[p.page]) if len(kept) else np.zeros(len(p.words), bool)
        number_of = np.where(here, order[kept][np.maximum(before, 0)] + 1, 0) if len(kept) else np.zeros(len(p.words), np.int64)
        live = np.setdiff1d(np.arange(len(hit)), late)
        any_before = np.searchsorted(hit[live], np.arange(len(p.words)), "right") - 1
        inside = (any_before >= 0) & (hit[live][np.maximum(any_before, 0)] >= p.bounds[p.page]) if len(live) else np.zeros(len(p.words), bool)
        field_of = np.where(inside, field[live][np.maximum(any_before, 0)], 0) if len(live) else np.zeros(len(p.words), np.int64)
        value = np.cumsum(covered)
        word = np.flatnonzero(~covered & ~p.tag.astype(bool) & good[p.page])
        key = (p.page[word] << 40) | value[word] if len(word) else word
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(word) else np.zeros(0, np.int64)
        slots: list[list] = [[] for _ in htmls]
        for lo, hi in zip(cut, np.append(cut[1:], len(word))):
            text = " ".join([p.words[i] for i in word[lo:hi]])
            w = word[lo]
            slots[p.page[w]].append({"slot": int(number_of[w]), "field": int(field_of[w]), "text": unescape(text) if "&" in text else text})
        n = np.bincount(p.page[hit[live]], minlength=len(htmls))
        out = pa.RecordBatch.from_arrays([column_of(b, "i").cast(arrow_id), column_of(b, "h"), pa.array(np.where(n > 0, number, 0), pa.int32()), pa.array(n, pa.int32()), pa.array(slots, slot)], names=["page_id", "host", "template", "template_tokens", "slots"])
        yield out.filter(pa.array(good))


def _attach(table: DataFrame, path: str, rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows with their host's list in column m; an empty one for a host that has none."""
    joined = attach_by_group(rows, "h", table.withColumnRenamed("h", "kh"), path, "kh", totals.select(F.col("h").alias("kh"), "total"), "total")
    return joined.withColumn("m", F.coalesce("m", F.array().cast(table.schema["m"].dataType))).drop("kh")


def _deduce(pages: DataFrame, arrow_id, id_type, support: float, min_class: int, min_word_pages: int, tolerance: float) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """The lists of template tokens by host, their path, the sequences table of the pages (with those set aside), and the hosts' pages."""
    totals, totals_path = written(pages.groupBy("h").agg(F.count(F.lit(1)).alias("total")))
    rows = pages.select("i", "h", "t")
    found = rows.mapInArrow(lambda x: _candidates(x, support), "h string, k long, tag boolean, once long").groupBy("h", "k", "tag").agg(F.sum("once").alias("once"))
    found = found.join(small_enough(totals.withColumnRenamed("h", "th"), totals_path), F.col("h") == F.col("th")).withColumn("common", F.col("once") >= F.lit(support) * F.col("total") - 1e-9)
    listed = found.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "tag", "common"))).alias("m"))
    table, path = written(listed)
    id_field = T.StructField("i", id_type)
    seq_type = T.StructType([id_field, T.StructField("h", T.StringType()), T.StructField("good", T.BooleanType()), T.StructField("mark", T.LongType()), T.StructField("seq", T.ArrayType(T.IntegerType())), T.StructField("t", T.StringType())])
    sequences, _ = written(_attach(table, path, rows, totals).mapInArrow(lambda x: _sequences(x, arrow_id), seq_type))
    mine = sequences.where("good").select("h", "mark", "seq")

    sums = mine.mapInArrow(_vectors, "h string, x int, n long, lo long, hi long, m long, at double").groupBy("h", "x").agg(*[F.sum(c).alias(c) for c in ("n", "lo", "hi", "m", "at")])
    counted = mine.groupBy(F.col("h").alias("th")).agg(F.count(F.lit(1)).alias("total"))
    tokens = table.select("h", F.posexplode("m").alias("x", "t")).select("h", "x", F.col("t.tag").alias("tag"))
    # joins of what is bounded per host, all on the host or the token
    frequent = sums.join(counted, F.col("h") == F.col("th")).drop("th").where((F.col("n") >= F.lit(support) * F.col("total") - 1e-9) & (F.col("total") > 1)).join(tokens, ["h", "x"])
    frequent = frequent.where(F.col("tag") | (F.col("total") >= min_word_pages))
    vector = ["h", "n", "lo", "hi", "m"]
    frequent = frequent.withColumn("z", F.count(F.lit(1)).over(Window.partitionBy(*vector)))
    once = F.col("m") == F.col("n")
    frequent = frequent.where((F.col("z") >= min_class) | (once & (F.col("n") == F.col("total"))))
    frequent, _ = written(frequent.withColumn("once", once))

    # the root's order: the longest skeleton that enough pages have
    def lists(members: DataFrame, fields: dict) -> tuple[DataFrame, str]:
        """Each host's whole list with what members say; tokens without a word have class -1."""
        every = table.select("h", F.posexplode("m").alias("x", "t")).select("h", "x", "t.k", "t.tag", "t.common")
        full = every.join(members, ["h", "x"], "left")
        values = [F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(-1)).cast("int").alias(k) for k, v in fields.items()]
        return written(full.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "tag", "common", *values))).alias("m")))

    nothing = F.lit(-1)
    first, first_path = lists(frequent.where("once").select("h", "x", F.lit(0).alias("c")), {"c": "c", "o": nothing, "z": nothing, "f": nothing})
    variants = _attach(first, first_path, mine, totals).mapInArrow(_skeletons, "h string, v long, s array<int>, pages long").groupBy("h", "v").agg(F.sum("pages").alias("pages"), F.first("s").alias("s"))
    enough = variants.join(counted, F.col("h") == F.col("th")).where(F.col("pages") >= F.lit(0.05) * F.col("total"))
    order = enough.groupBy("h").agg(F.max_by("s", F.struct(F.size("s"), "pages", "v")).alias("s")).select("h", F.posexplode("s").alias("o", "x"))
    order, _ = written(order)
    others = frequent.join(order.select("h", "x"), ["h", "x"], "left_anti").where(F.col("z") >= min_class)
    # sizes anew: a class may have lost members to the root
    others = others.withColumn("z", F.count(F.lit(1)).over(Window.partitionBy(*vector))).where(F.col("z") >= min_class)
    others = others.withColumn("o", F.row_number().over(Window.partitionBy(*vector).orderBy(F.col("at") / F.col("n"), "x")) - 1).withColumn("c", F.dense_rank().over(Window.partitionBy("h").orderBy("n", "lo", "hi", "m")))
    members = order.select("h", "x", F.lit(0).alias("c"), "o", F.lit(0).alias("z")).unionByName(others.select("h", "x", "c", "o", F.col("z").cast("int").alias("z")))
    members, _ = written(members)

    second, second_path = lists(members, {"c": "c", "o": "o", "z": "z", "f": nothing})
    checks = _attach(second, second_path, mine, totals).mapInArrow(_checks, "h string, c int, x int, d int, gap int, n long").groupBy("h", "c", "x", "d", "gap").agg(F.sum("n").alias("n"))
    checks, _ = written(checks)
    late = checks.where(F.col("x") >= 0).join(sums.select("h", "x", F.col("n").alias("pages")), ["h", "x"]).where(F.col("n") > F.lit(tolerance) * F.col("pages")).select("h", "x")
    ordered = checks.where(F.col("d") == -1).groupBy("h", "c").agg(F.sum(F.when(F.col("gap") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all")).where(F.col("bad") <= F.lit(tolerance) * F.col("all"))
    lies = checks.where((F.col("d") >= 0) & (F.col("x") < 0)).groupBy("h", "c", "d").agg(F.max("n").alias("most"), F.sum("n").alias("inside"))
    lies = lies.join(ordered.select("h", "c", "all"), ["h", "c"])
    valid = lies.where((F.col("d") == 0) & (F.col("most") >= (1 - tolerance) * F.col("all"))).select("h", "c", "all")
    # a class that lies across another, neither in one gap of it nor around it, goes if it is the smaller one
    pairs = lies.where(F.col("d") > 0).join(valid.select("h", "c"), ["h", "c"]).join(valid.select("h", F.col("c").alias("d"), F.col("all").alias("d_all")), ["h", "d"])
    nested = (F.col("most") >= (1 - tolerance) * F.col("all"))
    across = pairs.where(~nested & (F.col("inside") > F.lit(tolerance) * F.col("all")))
    within = pairs.where(nested).select("h", F.col("c").alias("d"), F.col("d").alias("c"))
    crossing = across.join(within, ["h", "c", "d"], "left_anti").where((F.col("all") < F.col("d_all")) | ((F.col("all") == F.col("d_all")) & (F.col("c") > F.col("d")))).select("h", "c").distinct()
    valid = valid.select("h", "c").join(crossing, ["h", "c"], "left_anti")
    roots = members.where(F.col("c") == 0).join(late, ["h", "x"], "left_anti").withColumn("f", F.lit(0))
    inner = members.where(F.col("c") > 0).join(valid, ["h", "c"], "left_semi").select(*members.columns).withColumn("f", F.row_number().over(Window.partitionBy("h").orderBy("c", "o")))
    last, last_path = lists(roots.unionByName(inner), {"c": "c", "o": "o", "z": "z", "f": "f"})
    return last, last_path, sequences, totals


def extract(pages: DataFrame, *, page_id="page_id", url="url", html="html", support: float = 0.5, min_class: int = 2, min_word_pages: int = 5, tolerance: float = 0.05, max_templates: int = 4) -> DataFrame:
    """page_id, host, template, template_tokens (occurrences covered) and slots of every page."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = pages.schema[page_id].dataType
    arrow_id = to_arrow_type(id_type)
    source = bounded_batches(pages).select(col(pages, page_id).alias("i"), F.coalesce(_host(col(pages, url)), F.lit("")).alias("h"), F.coalesce(col(pages, html), F.lit("")).alias("t"))
    slot = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("field", T.IntegerType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField("page_id", id_type), T.StructField("host", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("template_tokens", T.IntegerType()), T.StructField("slots", T.ArrayType(slot))])
    nothing = F.array().cast(T.ArrayType(_MEMBERS))
    # a page without tokens has no slots; counted, it would only blur what the others have in common
    counts = (F.col("h") != "") & F.col("t").rlike(r"(?U)[^\s\x1c-\x1f]")
    out = source.where(~counts).withColumn("m", nothing).mapInArrow(lambda x: _extract(x, arrow_id, 0, True), schema)
    rest = source.where(counts)
    for number in range(1, max_templates + 1):
        table, path, sequences, totals = _deduce(rest, arrow_id, id_type, support, min_class, min_word_pages, tolerance)
        mine = _attach(table, path, rest, totals)
        out = out.unionByName(mine.mapInArrow(lambda x, n=number: _extract(x, arrow_id, n, False), schema))
        aside = sequences.where(~F.col("good")).select("i", "h", "t")
        if aside.isEmpty():
            return out
        rest = aside
    return out.unionByName(rest.withColumn("m", nothing).mapInArrow(lambda x: _extract(x, arrow_id, 0, True), schema))
