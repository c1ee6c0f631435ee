"""HTML to an element column, and selector search over it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.columns import count_below, let
from pagemill.functions.html_tree import PageTree

NODE_TYPE = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
)
DOM_TYPE = T.StructType(
    [T.StructField("text", T.BinaryType()), T.StructField("nodes", T.ArrayType(NODE_TYPE))]
)


# Of pages whose nodes are Python lists at once, and that come out as one Arrow batch. An element may take three bytes
# of a page and some hundred here.
PART_BYTES = 512 << 10


def _list_array(counts: list[int], values: pa.Array) -> pa.ListArray:
    offsets, total = [0], 0
    for n in counts:
        total += n
        offsets.append(total)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _dom_batch(html: pa.Array) -> pa.Array:
    """Parse a few pages; every column of the result is built flat, once for all of them."""
    texts, counts = [], []
    index, last, parent, tags, start, stop = [], [], [], [], [], []
    attr_offsets, keys, values = [0], [], []
    for page in html.cast(pa.binary()).to_pylist():
        tree = PageTree(page.decode("utf-8", "replace") if page else "")
        texts.append(b"".join(tree.text))
        counts.append(len(tree.rows))
        index.extend(range(1, len(tree.rows) + 1))
        for up, tag, attrs, first, end, to in tree.rows:
            parent.append(up)
            tags.append(tag)
            start.append(first)
            stop.append(end)
            last.append(to)
            if attrs:
                keys.extend(attrs)
                values.extend(attrs.values())
            attr_offsets.append(len(keys))
    attr_map = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    ints = [pa.array(c, pa.int32()) for c in (index, last, parent, start, stop)]
    nodes = pa.StructArray.from_arrays(
        [ints[0], ints[1], ints[2], pa.array(tags, pa.string()), attr_map, ints[3], ints[4]],
        names=["i", "last", "parent", "tag", "attrs", "start", "stop"],
    )
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.binary()), _list_array(counts, nodes)], names=["text", "nodes"]
    )


def _parts(html: pa.Array, size: int = PART_BYTES) -> list[pa.Array]:
    """A batch in pieces of about ``size`` bytes, so that few pages are Python lists at once."""
    done, todo = [], [html]
    while todo:
        part = todo.pop()
        if len(part) > 1 and part.nbytes > size:
            half = len(part) // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            done.append(part)
    return done


@F.arrow_udf(DOM_TYPE)
def _dom_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # each part goes out when it is parsed: Spark bounds a batch by its pages, not by the elements in them
    for html in batches:
        for part in _parts(html):
            yield _dom_batch(part)


# Marked nondeterministic so that the optimizer never copies the call: each page is parsed once however many
# columns are derived from it. Put filters on url, status or robots rules before this call.
_dom_once = _dom_udf.asNondeterministic()


def html_nodes(html: Column) -> Column:
    """Element table of a page: ``struct<text, nodes>``.

    ``text`` is the page's text in UTF-8; ``nodes`` are its elements in document order. Element ``n`` holds the
    elements with ``n.i < i <= n.last`` and the text bytes ``[n.start, n.stop)``.
    """
    return _dom_once(html)


# --- selectors --------------------------------------------------------------------------------------------
_PART = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|"""
    r"""\[\s*(?P<attr>[\w:.-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<q>["']?)(?P<val>.*?)(?P=q)\s*)?\]"""
)
_STEP = re.compile(r"""(?:\[[^\]]*\]|[^\s\[\],>+~])+""")


def _has_word(value: Column, word: str) -> Column:
    return F.array_contains(F.split(value, r"[\t\n\f\r ]+"), word)


def _part_predicate(node: Column, m: re.Match) -> Column | None:
    attrs = node["attrs"]
    if m["tag"]:
        return None if m["tag"] == "*" else node["tag"] == m["tag"].lower()
    if m["id"]:
        return attrs["id"] == m["id"]
    if m["cls"]:
        return _has_word(attrs["class"], m["cls"])
    value, want = attrs[m["attr"].lower()], m["val"]
    if m["op"] is None:
        return value.isNotNull()
    if m["op"] == "=":
        return value == want
    if m["op"] == "|=":
        return (value == want) | value.startswith(want + "-")
    if want == "":
        return F.lit(False)
    if m["op"] == "~=":
        return _has_word(value, want)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[m["op"]](want)


def _compound(node: Column, step: str) -> Column:
    pos, parts = 0, []
    while pos < len(step):
        m = _PART.match(step, pos)
        if m is None or (m["tag"] and pos):
            raise ValueError(f"unsupported selector: {step!r}")
        parts.append(_part_predicate(node, m))
        pos = m.end()
    out = F.lit(True)
    for k, p in enumerate(q for q in parts if q is not None):
        out = p if k == 0 else out & p
    return F.coalesce(out, F.lit(False))


def matches_selector(node: Column, selector: str, nodes: Column | None = None) -> Column:
    """Predicate on one element. Comma lists, compounds of ``tag``, ``#id``, ``.class`` and ``[attr op 'v']``,
    and descendant steps (``nav a``; these need ``nodes``)."""
    alternatives: list[Column] = []
    singles = [s.strip() for s in re.split(r""",(?![^\[]*\])""", selector)]
    plain = [s.lower() for s in singles if re.fullmatch(r"[A-Za-z][\w-]*", s)]
    if plain:
        tag = node["tag"]
        alternatives.append(tag == plain[0] if len(plain) == 1 else tag.isin(plain))
    for single in singles:
        if single.lower() in plain:
            continue
        steps = _STEP.findall(single)
        if not steps or "".join(steps) != re.sub(r"\s+(?![^\[]*\])", "", single):
            raise ValueError(f"unsupported selector: {single!r}")
        alternatives.append(_path(node, steps, nodes))
    out = alternatives[0]
    for a in alternatives[1:]:
        out = out | a
    return out


def _path(node: Column, steps: list[str], nodes: Column | None) -> Column:
    here = _compound(node, steps[-1])
    if len(steps) == 1:
        return here
    if nodes is None:
        raise ValueError("a descendant selector needs the element column")
    above = F.exists(
        nodes,
        lambda up: (up["i"] < node["i"]) & (node["i"] <= up["last"]) & _path(up, steps[:-1], nodes),
    )
    return here & above


def select_nodes(dom: Column, selector: str) -> Column:
    """All elements matching ``selector``, in document order."""
    nodes = dom["nodes"]
    return F.filter(nodes, lambda n: matches_selector(n, selector, nodes))


def first_node(dom: Column, selector: str) -> Column:
    """First match or NULL."""
    return F.get(select_nodes(dom, selector), 0)


def text_slice(text: Column, start: Column, stop: Column) -> Column:
    """Bytes ``[start, stop)`` of the page text as a string; costs the length of the slice, not of the page."""
    return F.substring(text, start + 1, stop - start).cast("string")


def starts_of(ranges: Column) -> Column:
    """Numbers of the elements of ``ranges``, to be bound once for many calls of `text_without`."""
    return F.transform(ranges, lambda r: r["i"])


def text_without(text: Column, node: Column, cut: Column, starts: Column | None = None) -> Column:
    """Text of ``node`` without the elements of ``cut`` that lie strictly inside it (``cut`` in document order).
    ``starts`` is `starts_of` ``cut``; give it where this is used for many nodes of a page."""

    def joined(inner: Column) -> Column:
        kept = F.aggregate(
            inner,
            F.struct(node["start"].alias("pos"), F.lit("").alias("out")),
            lambda acc, r: F.when(
                r["start"] >= acc["pos"],
                F.struct(
                    r["stop"].alias("pos"),
                    F.concat(acc["out"], text_slice(text, acc["pos"], r["start"])).alias("out"),
                ),
            ).otherwise(acc),
            lambda acc: F.concat(acc["out"], text_slice(text, acc["pos"], node["stop"])),
        )
        none = inner.isNull() | (F.size(inner) == 0)
        return F.when(none, text_slice(text, node["start"], node["stop"])).otherwise(kept)

    return F.when(F.size(cut) == 0, text_slice(text, node["start"], node["stop"])).otherwise(
        let(_inner(node, cut, starts), joined)
    )


FEW = 8  # ranges tested one by one; more are found by halving, which gives the same


def _inner(node: Column, cut: Column, starts: Column | None) -> Column:
    """The elements of ``cut`` strictly inside ``node``: neighbours, because both are in document order."""

    def between(at: Column) -> Column:
        # element by element, because slice() copies the whole array first; NULL for none
        found = F.transform(F.sequence(at["first"], at["end"] - 1), lambda k: F.get(cut, k))
        return F.when(at["first"] < at["end"], found)

    def sliced(starts: Column) -> Column:
        first, end = count_below(starts, node["i"] + 1), count_below(starts, node["last"] + 1)
        return let(F.struct(first.alias("first"), end.alias("end")), between)

    few = F.filter(cut, lambda r: (r["i"] > node["i"]) & (r["i"] <= node["last"]))
    return F.when(F.size(cut) <= FEW, few).otherwise(let(starts_of(cut), sliced) if starts is None else sliced(starts))


def _held(nodes: Column, ranges: Column, keep: bool, own: bool) -> Column:
    """Ranges nest or are apart, so a node is held if more of them begin before it than end before it."""

    def answer(held: Column) -> Column:
        return held if keep else ~held

    def one_by_one(n: Column) -> Column:
        begins = lambda r: r["i"] <= n["i"] if own else r["i"] < n["i"]
        return answer(F.exists(ranges, lambda r: begins(r) & (n["i"] <= r["last"])))

    def halving(at: Column) -> Column:
        first = 1 if own else 0
        return F.filter(
            nodes, lambda n: answer(count_below(at["starts"], n["i"] + first) > count_below(at["ends"], n["i"]))
        )

    ends = F.array_sort(F.transform(ranges, lambda r: r["last"]))
    sides = F.struct(F.transform(ranges, lambda r: r["i"]).alias("starts"), ends.alias("ends"))
    return F.when(F.size(ranges) <= FEW, F.filter(nodes, one_by_one)).otherwise(let(sides, halving))


def outside(nodes: Column, ranges: Column) -> Column:
    """``nodes`` that are in no range; a range holds its own element too."""
    return _held(nodes, ranges, keep=False, own=True)


def strictly_inside(nodes: Column, ranges: Column) -> Column:
    """``nodes`` that are inside of another element of ``ranges``."""
    return _held(nodes, ranges, keep=True, own=False)
