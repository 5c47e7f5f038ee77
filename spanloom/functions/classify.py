"""Ordered first-match classification of kernel, graph and module names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default rules, tried in this order, unanchored and without case.
KERNEL_RULES = [
    ("communication", "all_reduce|allreduce|cross_device_reduce|nccl|rccl|broadcast|allgather|reduce_scatter|quickreduce|all_to_all"),
    ("embedding", "embedding|rotary|rope|pos_enc"),
    ("attention", "aiter::mla_|mla_a8w8|decode_attention|flash_attn|attention|softmax|fmha_|FmhaBatchPrefill|mla_reduce|kv_cache|flashinfer|set_mla_kv|paged_attention|radix|chunk_gated_delta_rule|chunk_fwd_kernel|causal_conv1d|fused_gdn"),
    ("moe", "fused_moe|moe_align|topk|expert|MoeFlatmm|MoeSorting|kernel_moe_gemm|kernel_moe_mxgemm|shared_experts|grouped_topk|moe_fused_gate|moeSoftmax"),
    ("quantization", "mxfp4|fp8|quant|_gemm_afp4|_fused_rms_mxfp4|dynamic_per_group_scaled_quant|_dynamic_mxfp4|fp4x2|_gemm_a8w8|_batched_gemm_a8w8|_fused_rms_fp8"),
    ("gemm", "Cijk_Alik_Bljk|Cijk_Ailk_Bljk|Cijk_SB_|_gemm_a16_w16|Custom_Cijk|gemm|matmul|nvjet"),
    ("normalization", "layer_norm|rmsnorm|rms_norm|batch_norm|group_norm|scale_shift|rsqrt|_mean_pow"),
    ("conv", "conv2d|conv3d|convolution|Im2Col"),
    ("elementwise", "vectorized_elementwise|elementwise_kernel|binary_op|unary_op|aten::add|aten::mul|aten::sub|aten::div|aten::neg|aten::abs|aten::clamp|add_kernel|mul_kernel|sub_kernel|div_kernel|fused_add|residual_add|CastKernel|cast_kernel|type_cast|fused_bias|_to_copy|fused_copy_|fused_zeros|fused_any|fused_fill|fused_where|fused_mul_|fused_pow|fused_neg|fused_abs|act_and_mul|silu|gelu|relu|swish|sigmoid_gating"),
]
# Kinds of graph-replayed kernels.
GRAPH_RULES = [
    ("COMM", "all_reduce|allreduce|cross_device_reduce|nccl|rccl|broadcast|allgather|reduce_scatter|quickreduce|all_to_all"),
    ("ATTN", "aiter::mla_|mla_a8w8|decode_attention|flash_attn|attention|softmax|fmha_|mla_reduce|kv_cache|paged_attention|chunk_gated_delta_rule|fused_gdn|kn_get_mla_metadata|kn_mla_reduce|gating_delta_rule"),
    ("MOE", "fused_moe|moe_align|topk|expert|MoeFlatmm|MoeSorting|kernel_moe_gemm|kernel_moe_mxgemm|shared_experts|grouped_topk|fused_append_shared_experts"),
]
# Module classes.
MODULE_RULES = [
    ("lm_head", "LogitsProcessor|LMHead|lm_head"),
    ("sampler", "^Sampler$"),
    ("embedding", "Embed|Embedding|RotaryEmb|VocabParallel"),
    ("attention", "Attention|Attn|MLA|MultiHead|DeltaNet|RadixLinear"),
    ("moe_router", "Router|Gate(?!Proj)|TopK|MoEGate"),
    ("expert", "Expert|MoE(?!Gate)|FusedMoE|SparseMoe"),
    ("norm", "Norm|RMSNorm|LayerNorm|BatchNorm"),
    ("ffn", "MLP|FFN|FeedForward|SiluAndMul|Activation"),
    ("projection", "Linear|Proj|ColumnParallel|RowParallel|Merged|QKVParallel|Replicated"),
    ("infrastructure", "CudaGraph|Replay"),
    ("decoder_layer", "decoder|layer"),
    ("model_root", "causal|model|transformer"),
]
# Lower-case marks of a language model's modules.
LLM_MARKS = ["logitsprocessor", "sampler", "lmhead", "lm_head", "forcausallm", "causallm", "radixattention"]


def first_match(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern occurs in the name, whatever the case."""
    out = None
    for label, pattern in rules:
        hit = name.rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def kernel_category(name: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return first_match(name, KERNEL_RULES if rules is None else rules, "other")


def graph_kind(name: Column) -> Column:
    return first_match(name, GRAPH_RULES, "X")


def module_class(module_type: Column) -> Column:
    return first_match(module_type, MODULE_RULES, "default")


def segment_label(attn: Column, moe: Column, merged: Column | None = None) -> Column:
    label = F.when(attn & moe, "MoE").when(attn, "Attn").when(moe, "MoE").otherwise("other")
    return label if merged is None else F.when(merged, F.when(moe, "MoE").otherwise("FC")).otherwise(label)


def classified(df: DataFrame, name: str = "name", rules: list[tuple[str, str]] | None = None, out: str = "category") -> DataFrame:
    """Adds the category; the patterns run once per distinct name."""
    names = df.select(name).distinct().withColumn(out, kernel_category(F.col(name), rules))
    return df.join(names, name, "left")


def is_llm(types: DataFrame, column: str = "module_type") -> DataFrame:
    """One row: whether a module type has a language model's mark."""
    return types.agg(F.coalesce(F.max(F.lower(column).rlike("|".join(LLM_MARKS))), F.lit(False)).alias("is_llm"))
