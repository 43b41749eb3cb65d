"""Arrays, sparse maps and spans inside a row, and their long forms.

A span is ``struct<start:int,end:int>``, half-open, positions counted from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.columns import as_list


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Inside a lambda an expression is evaluated anew for each element; a lambda variable
    is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def span_width(s: Column) -> Column:
    return s["end"] - s["start"]


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0, null for null."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))


# The generators below take an expression, never a plain column: for a column the optimizer
# adds a filter on its size and pushes that through the projection that computes it, so
# a costly array would be computed twice.


def explode_rows(df: DataFrame, key, arr: str, out: str = "value") -> DataFrame:
    return df.select(*as_list(key), F.inline(F.transform(arr, lambda v: F.struct(v.alias(out)))))


def arr_to_pairs(
    df: DataFrame, key, arr: str, sparse: bool = False,
    predicate: Callable[[Column], Column] | None = None, keep_empty: bool = False,
) -> DataFrame:
    """Array to (key, pos, value).

    ``sparse`` keeps the non-zero entries, or those of ``predicate``.  The filter runs
    inside the row, before the explode, so dropped entries never become rows;
    ``keep_empty`` gives a row without entries its key with nulls.
    """
    if predicate is not None and not sparse:
        raise ValueError("a predicate needs sparse=True")
    pairs = F.transform(arr, lambda v, i: F.struct(i.alias("pos"), v.alias("value")))
    if sparse:
        keep = predicate or (lambda v: v != 0)
        pairs = F.filter(pairs, lambda p: keep(p["value"]))
    spread = F.explode_outer if keep_empty else F.explode
    return df.select(*as_list(key), spread(pairs).alias("_p")).select(*as_list(key), "_p.pos", "_p.value")


def map_to_pairs(df: DataFrame, key, col: str, keep_empty: bool = False) -> DataFrame:
    """Map to (key, k, v)."""
    spread = F.explode_outer if keep_empty else F.explode
    return df.select(*as_list(key), spread(F.map_entries(col)).alias("_e")).select(
        *as_list(key), F.col("_e.key").alias("k"), F.col("_e.value").alias("v"))


def keep_empty(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Restores the keys an explode or a filter lost."""
    return df.select(key).join(pairs, key, "left")


def pairs_to_map(df: DataFrame, key, k: str, v: str, out: str, repeated: str = "raise") -> DataFrame:
    """(key, k, v) to one map per key, entries in key order.

    The result holds a map per key, so a key's entries have to meet in one row; a map
    has each k once, so repeated pairs are folded before they are collected.  Of several
    values of one k the largest or smallest stays with ``repeated`` "max" or "min"; by
    default they raise.
    """
    keys = as_list(key)
    if repeated not in ("raise", "max", "min"):
        raise ValueError(repeated)
    one = (F.min if repeated == "min" else F.max)(v)
    if repeated == "raise":
        several = F.concat(F.lit("several values of "), F.col(k).cast("string"))
        one = F.when(F.min(v).eqNullSafe(F.max(v)), F.max(v)).otherwise(F.raise_error(several))
    once = df.groupBy(*keys, k).agg(one.alias(v))
    entries = F.sort_array(F.collect_list(F.struct(k, v)))
    return once.groupBy(*keys).agg(F.map_from_entries(entries).alias(out))


def pad(arr: Column, n: Column | int, fill=0) -> Column:
    """Right-pads or cuts to length n."""
    n = F.lit(n) if isinstance(n, int) else n
    gap = F.greatest(n - F.size(arr), F.lit(0))
    return F.slice(F.concat(arr, F.array_repeat(F.lit(fill), gap)), 1, n)


def densify(m: Column, n: Column, fill: float = 0.0) -> Column:
    """Sparse map to a dense array of length n, in time linear in entries plus n.

    Sorted entries are laid end to end with the gaps between them; looking each position
    up in the map would scan the map once per position.
    """
    fill_col = F.lit(float(fill))

    def lay_out(entries: Column) -> Column:
        def block(e: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(entries, i - 1)["key"]).otherwise(F.lit(-1))
            return F.concat(
                F.array_repeat(fill_col, e["key"] - before - 1), F.array(e["value"].cast("double")))

        last = F.coalesce(F.get(entries, F.size(entries) - 1)["key"], F.lit(-1))
        body = F.flatten(F.transform(entries, block))
        return F.concat(body, F.array_repeat(fill_col, n - last - 1))

    inside = F.filter(F.map_entries(m), lambda e: (e["key"] >= 0) & (e["key"] < n))
    return bind(F.sort_array(inside), lay_out)


def by_cell(items: Column, first: Callable[[Column], Column], last: Callable[[Column], Column]) -> Column:
    """Structs laid out by the cells they cover: an array indexed by cell (from 0) of the
    items of that cell, in struct order.  Linear in the cells covered, but for one sort."""
    entries = F.sort_array(F.flatten(F.transform(items, lambda x: F.transform(
        F.sequence(first(x), last(x)), lambda c: F.struct(c.alias("cell"), x.alias("item"))))))

    def group(e: Column) -> Column:
        heads = F.filter(
            indices(F.size(e)), lambda i: (i == 0) | (F.get(e, i)["cell"] != F.get(e, i - 1)["cell"]))

        def cut(h: Column) -> Column:
            return F.transform(h, lambda at, j: F.struct(
                F.get(e, at)["cell"].alias("cell"),
                F.transform(
                    F.slice(e, at + 1, F.coalesce(F.get(h, j + 1), F.size(e)) - at),
                    lambda x: x["item"]).alias("items")))

        return bind(heads, cut)

    def spread(groups: Column) -> Column:
        def block(g: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(groups, j - 1)["cell"]).otherwise(F.lit(-1))
            nothing = F.filter(g["items"], lambda _: F.lit(False))
            return F.concat(F.array_repeat(nothing, g["cell"] - before - 1), F.array(g["items"]))

        return F.flatten(F.transform(groups, block))

    return bind(bind(entries, group), spread)


CELL_BITS = 5


def cell(position: Column) -> Column:
    """Cell of a text position; positions before the text belong to the first."""
    return F.shiftright(F.greatest(position, F.lit(0)), CELL_BITS)


def in_order(spans: Column) -> Column:
    """Spans follow one another without overlap, as words and tokens do."""
    def fits(i: Column) -> Column:
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        at = F.get(spans, i)
        return (at["start"] >= before) & (at["end"] >= at["start"])

    return F.forall(indices(F.size(spans)), fits)


def gap_before(spans: Column, s: Column, i: Column) -> Column:
    return s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))


def spans_to_mask(spans: Column, n: Column) -> Column:
    """Flag per position 0 .. n-1: inside one of the spans.

    Spans in order are laid end to end with their gaps.  Others are laid out by cells, and
    a position is tested against the spans that cover its cell.
    """
    off, on = F.lit(False), F.lit(True)

    def end_to_end(row: Column) -> Column:
        blocks = F.transform(row["spans"], lambda s, i: F.concat(
            F.array_repeat(off, gap_before(row["spans"], s, i)), F.array_repeat(on, span_width(s))))
        last = F.coalesce(F.get(row["spans"], F.size(row["spans"]) - 1)["end"], F.lit(0))
        rest = F.array_repeat(off, F.greatest(row["n"] - last, F.lit(0)))
        return F.slice(F.concat(F.flatten(blocks), rest), F.lit(1), row["n"])

    def by_cells(row: Column) -> Column:
        wide = F.filter(row["spans"], lambda s: (s["end"] > s["start"]) & (s["end"] > 0))
        table = by_cell(wide, lambda s: cell(s["start"]), lambda s: cell(s["end"] - 1))
        size = 1 << CELL_BITS

        def flags(near: Column) -> Column:
            def of_cell(c: Column) -> Column:
                lower = F.shiftleft(c, CELL_BITS)
                view = F.struct(
                    F.sequence(lower, F.least(lower + size, row["n"]) - 1).alias("at"), F.get(near, c).alias("near"))
                return bind(view, lambda v: F.transform(v["at"], lambda i: F.coalesce(
                    F.exists(v["near"], lambda s: (i >= s["start"]) & (i < s["end"])), off)))

            return F.flatten(F.transform(indices(F.ceil(row["n"] / size).cast("int")), of_cell))

        return bind(table, flags)

    return bind(
        F.struct(spans.alias("spans"), n.cast("int").alias("n")),
        lambda row: F.when(in_order(row["spans"]), end_to_end(row)).when(row["spans"].isNotNull(), by_cells(row)))


def runs_of_true(flags: Column, tail_plus_one: bool = False) -> Column:
    """Half-open runs of true in a flag array; null counts as false.

    ``tail_plus_one`` lets a run that reaches the end stop at len+1.
    """
    tail = F.lit(1 if tail_plus_one else 0)

    def runs(a: Column) -> Column:
        n = F.size(a)

        def on(i: Column) -> Column:
            return F.coalesce(F.get(a, i), F.lit(False))

        starts = F.filter(indices(n), lambda i: on(i) & ((i == 0) | ~on(i - 1)))
        ends = F.filter(indices(n), lambda i: on(i) & ((i == n - 1) | ~on(i + 1)))
        return F.zip_with(
            starts, ends, lambda s, e: span(s, e + 1 + F.when(e == n - 1, tail).otherwise(F.lit(0))))

    return bind(flags, lambda a: F.when(a.isNotNull(), runs(a)))


def render_spans(flags: Column, spans: Column) -> Column:
    """A line of blanks with X under the flagged spans, as long as the last span's end."""
    width = F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    pairs = F.zip_with(flags, spans, lambda f, s: F.struct(f.alias("f"), s.alias("s")))
    marked = F.transform(F.filter(pairs, lambda z: z["f"]), lambda z: z["s"])

    def end_to_end(row: Column) -> Column:
        text = F.array_join(F.transform(row["marked"], lambda s, i: F.concat(
            F.repeat(F.lit(" "), gap_before(row["marked"], s, i)), F.repeat(F.lit("X"), span_width(s)))), "")
        return F.rpad(text, row["width"], F.lit(" "))

    def by_position(row: Column) -> Column:
        mask = spans_to_mask(row["marked"], row["width"])
        return F.array_join(F.transform(mask, lambda b: F.when(b, F.lit("X")).otherwise(F.lit(" "))), "")

    return bind(
        F.struct(marked.alias("marked"), width.alias("width")),
        lambda row: F.when(in_order(row["marked"]), end_to_end(row)).when(row["marked"].isNotNull(), by_position(row)))


def sum_widths(spans: Column) -> Column:
    """Total width of a row's spans, without exploding them."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + span_width(s))


def sum_values(m: Column) -> Column:
    """Sum of a row's map values, without exploding them."""
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v)
