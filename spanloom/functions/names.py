"""Name parsing: spans, kernels, report tabs and source frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_PREFIX = "nn.Module: "
# Frames of frameworks and of wrappers.
FRAMEWORK_PREFIXES = ["torch/", "threading.py", "multiprocessing/", "<string>", "tqdm/", "importlib/", "contextlib.py"]
WRAPPER = r":\s*(?:wrapper|custom_wrapper|outer_wrapper|wrapper_custom|__call__|_call_impl|<lambda>|<module>|<genexpr>|decorate_context|decorate_fwd|run)\s*$"
BUILTIN = r"^<built-in (?:method|function) (\S+)"


def module_type(name: Column) -> Column:
    """Part before a final _N."""
    return F.when(name.rlike(r"^.+_\d+$"), F.regexp_replace(name, r"_\d+$", "")).otherwise(name)


def instance_id(name: Column) -> Column:
    """N of a final _N, 0 without one."""
    return F.when(name.rlike(r"^.+_\d+$"), F.regexp_extract(name, r"_(\d+)$", 1).cast("long")).otherwise(F.lit(0).cast("long"))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_kernel(name: Column) -> Column:
    """A kernel's display name; the first fitting rule decides."""
    tile = F.regexp_extract(name, r"MT(\d+x\d+x\d+)", 1)

    def gemm(plain: str) -> Column:
        return F.when(tile != "", F.concat(F.lit("hipblaslt GEMM ("), tile, F.lit(")"))).otherwise(plain)

    fused = F.regexp_extract(name, r"^triton_\w+_(fused_\w+?)_\d+$", 1)
    return (
        F.when(name.contains("fmha_fwd_hd128_bf16"), "aiter::fmha_fwd_hd128_bf16")
        .when(name.contains("ck_tile") & name.contains("FmhaFwd"), "ck_tile::FmhaFwd")
        .when(name.contains("Memcpy HtoD"), "Memcpy HtoD")
        .when(name.contains("Memcpy DtoH"), "Memcpy DtoH")
        .when(name.contains("Custom_Cijk"), gemm("hipblaslt GEMM"))
        .when(name.contains("rcclGenericKernel"), "RCCL AllReduce")
        .when(name.contains("kernel_grouped_conv"), "CK GroupedConv")
        .when(name.contains("_rotary_embedding"), "rotary_embedding")
        .when(name.contains("Cijk_Ailk"), gemm("hipblaslt GEMM (small)"))
        .when(F.trim(name) == "attn_fwd", "attn_fwd (dist)")
        .when(fused != "", F.concat(F.lit("triton::"), fused))
        .when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("...")))
        .otherwise(name)
    )


def tab_parts(tab: Column) -> dict[str, Column]:
    """base, phase and variant of a report tab's name, as columns."""
    pattern = r"^(.+?)\s*\(([^)]+)\)\s*$"
    fits = tab.rlike(pattern)
    parts = F.transform(F.split(F.regexp_extract(tab, pattern, 2), ","), lambda p: F.trim(p))
    letter = F.filter(parts, lambda p: p.rlike("^[A-Z]$"))
    phase = F.filter(parts, lambda p: ~p.rlike("^[A-Z]$"))

    def last(a: Column) -> Column:
        return F.when(fits & (F.size(a) > 0), F.element_at(a, -1)).otherwise("")

    return {"base": F.when(fits, F.trim(F.regexp_extract(tab, pattern, 1))).otherwise(F.trim(tab)), "phase": last(phase), "variant": last(letter)}


def tab_name(type_: Column, phase: Column, variant: Column) -> Column:
    """A tab's name within 28 characters: the type is cut, the suffix stays."""
    inside = F.concat_ws(",", F.when(phase == "prefill", "pre").when(phase == "decode", "dec"), F.when(variant != "", variant))
    suffix = F.when(inside != "", F.concat(F.lit(" ("), inside, F.lit(")"))).otherwise("")
    return F.concat(F.substring(type_, F.lit(1), F.lit(28) - F.length(suffix)), suffix)


def source_tier(frame: Column) -> Column:
    """1 application frame, 2 its wrapper, 3 framework frame with a source, 4 the rest."""
    framework = F.lit(False)
    for p in FRAMEWORK_PREFIXES:
        framework = framework | frame.startswith(p)
    py = frame.contains(".py(")
    return F.when(py & ~framework & ~frame.rlike(WRAPPER), 1).when(py & ~framework, 2).when(py, 3).otherwise(4)


def source_label(frame: Column) -> Column:
    built_in = F.regexp_extract(frame, BUILTIN, 1)
    return F.when(~frame.contains(".py(") & (built_in != ""), F.concat(F.lit("<built-in "), built_in, F.lit(">"))).otherwise(frame)


def indented(text: Column) -> dict[str, Column]:
    """Depth (four spaces a level) and name of an indented entry."""
    spaces = F.length(F.regexp_extract(text, "^( *)", 1))
    return {"depth": F.floor(spaces / 4).cast("int"), "name": F.trim(text)}
