"""FLOP estimates from tensor shapes, as column expressions over array<array<bigint>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attention kernels that compute nothing, and head sizes in names.
ATTENTION_SKIP = "(?i)mla_reduce|kn_mla_reduce|softmax|kv_cache|set_mla_kv|kn_get_mla_metadata|paged_attention|PagedKVCache|radix"
QH_VH = r"(?i)qh(\d+)_vh(\d+)"
HD = r"(?i)hd(\d+)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time: an expression that is put in many
    places inside lambda functions would be computed at each of them."""
    return F.get(F.transform(F.array(value), use), 0)


def parsed_dims(text: Column) -> Column:
    """Shapes of a literal like [[2, 3], [], [4]]; null if it isn't one."""
    return F.when(F.trim(text).startswith("["), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<array<bigint>>"))


def shaped(dims: Column) -> Column:
    """Non-empty shapes; null if there is none."""
    return once(F.filter(dims, lambda d: F.size(d) > 0), lambda kept: F.when(F.size(kept) > 0, kept))


def pair_flops(a: Column, b: Column) -> Column:
    """2MKN of two shapes: [M,K]@[K,N], else [M,K]@[N,K]; batched alike; null otherwise."""

    def at(x: Column, k: int) -> Column:
        return F.get(x, k).cast("double")

    plain = F.when(at(a, 1) == at(b, 0), 2 * at(a, 0) * at(a, 1) * at(b, 1)).when(at(a, 1) == at(b, 1), 2 * at(a, 0) * at(a, 1) * at(b, 0))
    batched = F.when(at(a, 0) == at(b, 0), F.when(at(a, 2) == at(b, 1), 2 * at(a, 0) * at(a, 1) * at(a, 2) * at(b, 2)).when(at(a, 2) == at(b, 2), 2 * at(a, 0) * at(a, 1) * at(a, 2) * at(b, 1)))
    return F.when((F.size(a) == 2) & (F.size(b) == 2), plain).when((F.size(a) == 3) & (F.size(b) == 3), batched)


def gemm_flops(dims: Column) -> Column:
    """FLOPs of the first pair of 2- or 3-dimensional shapes that multiply."""

    def first_pair(m: Column) -> Column:
        found = F.flatten(F.transform(m, lambda a, i: F.transform(F.filter(m, lambda b, j: j > i), lambda b: pair_flops(a, b))))
        return F.get(F.filter(found, lambda x: x.isNotNull()), 0)

    return once(dims, lambda every: F.when(F.size(every) >= 2, once(F.filter(every, lambda d: F.size(d).isin(2, 3)), first_pair)))


def attention_flops(dims: Column, name: Column) -> Column:
    """2*Sq*Skv*H*(dqk+dv) of an attention kernel; null where the shapes don't tell."""

    def at(x: Column, k: int) -> Column:
        return F.get(x, k)

    qk = F.regexp_extract(name, QH_VH, 1).try_cast("bigint")
    v = F.regexp_extract(name, QH_VH, 2).try_cast("bigint")
    hd = F.regexp_extract(name, HD, 1).try_cast("bigint")
    widths = F.struct(F.coalesce(qk, hd).alias("qk"), F.coalesce(v, hd).alias("v"))

    def ranked(three: Column) -> Column:
        """Head counts, most tensors first, then in order of first sight."""
        heads = F.array_distinct(F.transform(three, lambda t: at(t, 1)))
        return F.transform(
            F.array_sort(F.transform(heads, lambda h, i: F.struct((-F.size(F.filter(three, lambda t: at(t, 1) == h))).alias("n"), i.alias("i"), h.alias("h")))),
            lambda s: s["h"],
        )

    def width_sum(g: Column) -> Column:
        d = F.sort_array(F.array_distinct(F.transform(g, lambda t: at(t, 2).cast("double"))), False)
        return once(d, lambda d: F.when(F.size(d) == 1, 2 * F.get(d, 0)).otherwise(F.get(d, 0) + F.get(d, 1)))

    def by_name(named: Column, width: Column, w: Column) -> Column:
        seq = F.transform(named, lambda t: at(t, 0).cast("double"))
        return F.when(F.size(named) >= 2, once(seq, lambda q: 2 * F.array_max(q) * F.array_min(q) * width * (w["qk"] + w["v"])))

    def by_shape(group: Column, width: Column) -> Column:
        def of(x: Column) -> Column:
            same = F.filter(group, lambda t: at(t, 0) == x["most"])
            return F.when(F.size(same) >= 2, 2 * x["most"] * x["most"] * width * width_sum(same)).when(x["least"] < x["most"], 2 * x["least"] * x["most"] * width * width_sum(group))

        seqs = F.transform(group, lambda t: at(t, 0).cast("double"))
        return once(once(seqs, lambda q: F.struct(F.array_max(q).alias("most"), F.array_min(q).alias("least"))), of)

    def of_group(three: Column, h: Column, w: Column) -> Column:
        width = h.cast("double")

        def of(group: Column) -> Column:
            named = F.filter(group, lambda t: at(t, 2) == w["qk"])
            return F.when(F.size(group) >= 2, F.when(w["qk"].isNotNull(), once(named, lambda g: by_name(g, width, w))).otherwise(by_shape(group, width)))

        return once(F.filter(three, lambda t: at(t, 1) == h), of)

    def of_shapes(three: Column) -> Column:
        found = once(widths, lambda w: F.filter(F.transform(ranked(three), lambda h: of_group(three, h, w)), lambda x: x.isNotNull()))
        return F.when(F.size(three) >= 2, F.get(found, 0))

    return F.when(~name.rlike(ATTENTION_SKIP), once(F.filter(dims, lambda d: F.size(d) == 3), of_shapes))


def flops(dims: Column, category: Column, name: Column) -> Column:
    kind = F.lower(category)
    return F.when(kind == "attention", attention_flops(dims, name)).when(kind.isin("gemm", "moe"), gemm_flops(dims))


def formula(value: Column, category: Column) -> Column:
    return F.when(value.isNull(), "").when(F.lower(category) == "attention", "2*Sq*Skv*H*(dqk+dv)").otherwise("2*M*K*N")


def tflop(value: Column) -> Column:
    return value / 1e12


def tflop_rate(value: Column, dur_us: Column) -> Column:
    return F.when(dur_us > 0, value / 1e12 / (dur_us / 1e6))
