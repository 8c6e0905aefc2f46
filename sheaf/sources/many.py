"""Many plainly written pages read at once: their nodes as columns in numpy and Arrow, for what ``dom.Page`` does page by page."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import dom

TEXT = {"tag": "#text", "classes": [], "attrs": []}
_SPACE = " \t\n\r\f"


class _Odd(Exception):
    """Pages (a mask) that are to be read one by one."""

    def __init__(self, pages: np.ndarray):
        super().__init__()
        self.pages = pages


def strings(offsets: np.ndarray, data) -> pa.Array:
    """The texts between neighbouring offsets of a buffer."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - ends(size)[:-1], size)


class Pages:
    """Nodes of all pages in document order, as columns; descendants of x are those with x < id < stop[x]."""

    def __init__(self, html: pa.Array):
        self.size = len(html)
        at = np.frombuffer(html.buffers()[1], np.int32)[html.offset : html.offset + len(html) + 1]
        data = np.frombuffer(html.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at.astype(np.int64) - at[0]
        lt, page, code, keep, raw = self._tags(data, at)
        heads, kind = self.heads, self._kind[code]
        lt, close, page, code, kind, raw = (x[keep] for x in (lt, self._close, page, code, kind, raw))
        bounds = np.append(np.stack([lt, close], 1).ravel(), len(data))
        texts = strings(bounds, data).take(pa.array(np.arange(1, 2 * len(lt), 2)))
        self._nodes(page, code, kind, np.array([h["tag"] in dom.VOID for h in heads], bool)[code], (bounds[2::2] - close) > 0, texts, raw)

    def _tags(self, data: np.ndarray, at: np.ndarray):
        """Where tags are, of which page and head, which are no text of a script, and after which such text follows."""
        n = self.size
        odd = np.zeros(n, bool)
        full = at[1:] > at[:-1]
        odd[full] = data[at[:-1][full]] != 60
        odd[np.searchsorted(at, np.flatnonzero(data == 0), "right") - 1] = True
        if odd.any():
            raise _Odd(odd)
        lt, gt = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        page = np.searchsorted(at, lt, "right") - 1
        end = np.append(lt[1:], len(data)) if len(lt) else lt
        close = np.minimum(np.append(gt, len(data))[np.searchsorted(gt, lt)] + 1, end)
        coded = strings(np.append(np.stack([lt, close], 1).ravel(), len(data)), data).take(pa.array(np.arange(0, 2 * len(lt), 2))).dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        read = [dom.head(s[1:-1]) if s[-1] == ">" else None for s in names]
        self.heads = [{"tag": h[1], "classes": h[2], "attrs": h[3]} if h else TEXT for h in read]
        self._kind = np.array([h[0] if h else -1 for h in read], np.int8)
        self._close = close
        inside = [s[1:-1].lower().rstrip(_SPACE) if s[-1] == ">" else s[1:].lower() for s in names]
        shuts = {t: np.flatnonzero(np.array([s == "/" + t for s in inside], bool)[code]) for t in dom._RAW}
        risky = np.array([s.startswith(("!--", *("/" + t for t in dom._RAW))) for s in inside], bool)[code]
        keep, raw, done = np.ones(len(lt), bool), np.zeros(len(lt), bool), -1
        for r in np.flatnonzero(np.array([h["tag"] in dom._RAW for h in self.heads], bool)[code] & (self._kind[code] == 1)).tolist():
            if r < done:
                continue
            shut = shuts[self.heads[code[r]]["tag"]]
            k = np.searchsorted(shut, r)
            if k == len(shut) or page[shut[k]] != page[r] or risky[r + 1 : shut[k]].any():
                odd[page[r]] = True
                continue
            done = int(shut[k])
            keep[r + 1 : done], raw[r] = False, True
        kind = self._kind[code]
        odd[page[keep & (kind < 0)]] = True
        title = np.array([h["tag"] == "title" for h in self.heads], bool)[code]
        after = np.append(title & (kind == 2), False)[1:] & (np.append(page, -1)[1:] == page)
        odd[page[keep & title & (kind == 1) & ~after]] = True
        if odd.any():
            raise _Odd(odd)
        return lt, page, code, keep, raw

    def _nodes(self, page, code, kind, void, has_text, texts, raw):
        names = {t: i for i, t in enumerate(dict.fromkeys(h["tag"] for h in self.heads))}
        tag_of = np.array([names[h["tag"]] for h in self.heads], np.int64)
        push, pop = (kind == 1) & ~void, kind == 2
        depth = np.cumsum(push.astype(np.int64) - pop)
        last = np.searchsorted(page, np.arange(self.size), "right") - 1
        base = np.where(last[:-1] >= 0, depth[last[:-1]], 0) if len(depth) else np.zeros(max(self.size - 1, 0), np.int64)
        depth = depth - np.concatenate([[0], base])[page]
        odd = np.zeros(self.size, bool)
        odd[page[depth < 0]] = True
        if len(depth):
            odd[page[last[last >= 0]]] |= depth[last[last >= 0]] != 0
        if odd.any():
            raise _Odd(odd)
        both = np.flatnonzero(push | pop)
        order = both[np.argsort((depth + pop)[both], kind="stable")]
        start, stop = order[0::2], order[1::2]
        odd[page[start[tag_of[code[start]] != tag_of[code[stop]]]]] = True
        if odd.any():
            raise _Odd(odd)
        valid = np.stack([kind == 1, has_text], 1).ravel()
        before = np.cumsum(valid) - valid
        stops = before + 1
        stops[2 * start] = before[2 * stop]
        spread = lambda x: np.repeat(x, 2)[valid]
        is_text = np.tile([False, True], len(kind))[valid]
        self.page, self.stop, self.is_text = spread(page), stops[valid], is_text
        self.head = np.where(is_text, len(self.heads), spread(code))
        self.heads = [*self.heads, TEXT]
        level = np.stack([depth - push, depth], 1).ravel()[valid]
        pushed = np.stack([push, np.zeros(len(push), bool)], 1).ravel()[valid]
        self.parent = self._parents(level, pushed)
        self._implied(names, np.append(tag_of, names.setdefault("#text", len(names))), pushed)
        kept = texts.filter(pa.array(has_text))
        again = pc.match_substring(kept, "&").to_numpy(zero_copy_only=False) & ~raw[has_text]
        if again.any():
            kept = pc.replace_with_mask(kept, pa.array(again), pa.array([unescape(t) for t in kept.filter(pa.array(again)).to_pylist()], pa.string()))
        self.texts = kept
        self.text_before = ends(is_text)  # of each node
        self.first = np.searchsorted(self.page, np.arange(self.size + 1))

    @staticmethod
    def _parents(level: np.ndarray, pushed: np.ndarray) -> np.ndarray:
        parent = np.full(len(level), -1)
        starts = np.flatnonzero(pushed)
        items, starts = np.argsort(level, kind="stable"), starts[np.argsort(level[starts], kind="stable")]
        most = int(level.max(initial=0))
        cut, cut_s = np.searchsorted(level[items], np.arange(most + 2)), np.searchsorted(level[starts], np.arange(most + 1))
        for k in range(1, most + 1):
            mine, open_ = items[cut[k] : cut[k + 1]], starts[cut_s[k - 1] : cut_s[k]]
            parent[mine] = open_[np.searchsorted(open_, mine) - 1]
        return parent

    def _implied(self, names: dict[str, int], tag_of: np.ndarray, pushed: np.ndarray) -> None:
        """Pages where a start ends an open node are read one by one."""
        shut, scope = np.zeros((2, len(names), len(names)), bool)
        for t, closes in dom.CLOSES.items():
            for u in names if t in names else ():
                shut[names[t], names[u]], scope[names[t], names[u]] = u in closes, u in dom.SCOPE - closes
        tags = tag_of[self.head]
        mine = np.flatnonzero(shut.any(1)[tags] & ~self.is_text)
        above, odd = self.parent[mine], np.zeros(self.size, bool)
        while True:
            mine, above = mine[above >= 0], above[above >= 0]
            if not len(mine):
                break
            hit = shut[tags[mine], tags[above]]
            odd[self.page[mine[hit]]] = True
            more = ~hit & ~scope[tags[mine], tags[above]]
            mine, above = mine[more], self.parent[above[more]]
        if odd.any():
            raise _Odd(odd)

    # Masks are over nodes; ``group`` numbers what nodes belong to, in rising order.

    def where(self, test: Callable[[dict], bool]) -> np.ndarray:
        """Nodes whose tag passes."""
        return np.array([bool(test(h)) for h in self.heads], bool)[self.head]

    @cached_property
    def _index(self) -> tuple[dict, dict, dict]:
        """Which tags have a kind, a class, and an attribute with its value: each is read once, however many are asked for."""
        kinds, classes, attrs = {}, {}, {}
        for i, h in enumerate(self.heads):
            kinds.setdefault(h["tag"], []).append(i)
            for c in h["classes"]:
                classes.setdefault(c, []).append(i)
            for k, v in h["attrs"]:
                attrs.setdefault(k, []).append((i, v))
        return kinds, classes, attrs

    def _of_heads(self, heads: list[int]) -> np.ndarray:
        out = np.zeros(len(self.heads), bool)
        out[heads] = True
        return out[self.head]

    def kind(self, tag: str) -> np.ndarray:
        return self._of_heads(self._index[0].get(tag, []))

    def cls(self, name: str) -> np.ndarray:
        return self._of_heads(self._index[1].get(name, []))

    def having(self, name: str, test: Callable[[str], bool] = lambda v: True) -> np.ndarray:
        """Nodes with an attribute whose value passes."""
        return self._of_heads([i for i, v in self._index[2].get(name, []) if test(v)])

    @cached_property
    def _ids(self) -> np.ndarray:
        return np.arange(len(self.head))

    def within(self, nodes: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Those of ``nodes`` that are below one of ``boxes``."""
        reach = np.maximum.accumulate(np.concatenate([[0], np.where(boxes, self.stop, 0)]))[:-1]
        return nodes & (self._ids < reach)

    def nested(self, boxes: np.ndarray) -> np.ndarray:
        """Pages where one of ``boxes`` is below another."""
        out = np.zeros(self.size, bool)
        out[self.page[self.within(boxes, boxes)]] = True
        return out

    def owner(self, boxes: np.ndarray) -> np.ndarray:
        """Of each node the place in ``boxes`` (ids, none below another) of the one that it is below, or -1."""
        k = np.searchsorted(boxes, self._ids) - 1
        return np.where((k >= 0) & (self._ids < np.append(self.stop[boxes], 0)[k]), k, -1)

    def attrs(self, nodes: np.ndarray, name: str) -> pa.Array:
        """An attribute of some nodes (ids, -1 for none)."""
        values = [None] * (len(self.heads) + 1)
        for i, v in self._index[2].get(name, []):
            values[i] = v
        return pa.array(values, pa.string()).take(pa.array(np.where(nodes >= 0, self.head[nodes] if len(self.head) else -1, len(self.heads))))

    def texts_of(self, nodes: np.ndarray) -> pa.Array:
        """The text below each of some nodes (ids, -1 for none)."""
        return self.joined(nodes[nodes >= 0], np.flatnonzero(nodes >= 0), len(nodes), nodes >= 0)

    def joined(self, nodes: np.ndarray, group: np.ndarray, n: int, there: np.ndarray | None = None) -> pa.Array:
        """The text below (or of) a group's nodes in one, of each of ``n`` groups; null where not ``there``."""
        a = self.text_before[nodes]
        size = self.text_before[self.stop[nodes]] - a
        return self._join(ranges(a, size), np.bincount(group, size, n).astype(np.int64), there)

    def _join(self, texts: np.ndarray, counts: np.ndarray, there: np.ndarray | None) -> pa.Array:
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends(counts), pa.int32()), self.texts.take(pa.array(texts))), "")
        return out if there is None else pc.if_else(pa.array(there), out, None)

    @staticmethod
    def firsts(nodes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """Of each group the first node, or -1."""
        out = np.full(n, -1)
        out[group[::-1]] = nodes[::-1]
        return out

    @staticmethod
    def lists(values: pa.Array, group: np.ndarray, n: int) -> pa.Array:
        """A list for each group."""
        return pa.ListArray.from_arrays(pa.array(ends(np.bincount(group, minlength=n)), pa.int32()), values)

    def local(self, nodes: np.ndarray) -> pa.Array:
        """Ids as pages count them; null for -1."""
        return pa.array(nodes - self.first[self.page[nodes]] if len(self.page) else nodes, pa.int32(), mask=nodes < 0)

    def before(self, nodes: np.ndarray) -> np.ndarray:
        """Of each of some elements the element before it under the same parent, or -1."""
        elements = np.flatnonzero(~self.is_text)
        above = np.where(self.parent[elements] >= 0, self.parent[elements], -1 - self.page[elements])
        order = np.argsort(above, kind="stable")
        out = np.full(len(self.head), -1)
        same = above[order][1:] == above[order][:-1]
        out[elements[order][1:][same]] = elements[order][:-1][same]
        return out[nodes]

    def select(self, selector: list[list[Callable[[dict], bool]]]) -> np.ndarray:
        """Of each page the first match of the first alternative that has one, or -1."""
        out = np.full(self.size, -1)
        for parts in selector:
            found = self.where(parts[0])
            for test in parts[1:]:
                found = self.within(self.where(test), found)
            ids = np.flatnonzero(found)
            out = np.where(out >= 0, out, self.firsts(ids, self.page[ids], self.size))
        return out


def read(html: pa.Array, odd: Callable[[Pages], np.ndarray]) -> tuple[Pages, np.ndarray]:
    """The pages that are written plainly and aren't ``odd``, and which those are (ids); others are left out."""
    left = np.arange(len(html))
    html = pc.fill_null(html.cast(pa.string()), "")
    while True:
        try:
            pages = Pages(html)
            which = odd(pages)
            if which.any():
                raise _Odd(which)
            return pages, left
        except _Odd as e:
            html, left = html.filter(pa.array(~e.pages)), left[~e.pages]
