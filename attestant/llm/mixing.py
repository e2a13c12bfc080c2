"""Documents of several sources combined to target shares of the tokens.

Sainte-Lague apportionment hands out blocks of equal tokens one by one to the source with the highest quotient of its target by 2k + 1, k
being the blocks it has; a source that has used its documents as often as it may drops out. A source's blocks are apportioned to its shards
in the same way, and a shard's documents are drawn in seeded order until its blocks are full.
"""

from __future__ import annotations

import base64
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestant.llm.common import per_batch
from attestant.sources.tables import cut_lineage

#: Blocks handed out, blocks a shard has at least, and parts a shard's documents are put in order by, so that no task sorts a whole shard.
BLOCKS, BLOCKS_PER_SHARD, PARTS = 20_000, 256, 1024


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, tokens: byte-level BPE tokens of each text; null and empty texts have 0."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(vocabulary or tokenizer_file(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

        return step

    return per_batch(documents.select("doc_id", "source", "text"), make, "doc_id long, source string, tokens long")


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2k + 1), at most ``most`` each; ties go to the first. Weights of 0 get none."""
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        i = heap[0][1]
        got[i] += 1
        if got[i] < most[i]:
            heapq.heapreplace(heap, (-weights[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(heap)
    return got


def quotas(shards: list[dict], targets: dict[str, tuple[float, int]], total: int, block: int) -> list[dict]:
    """The shards (source, shard, tokens) with ``wanted`` tokens each."""
    by_source: dict[str, list[dict]] = {}
    for s in sorted(shards, key=lambda s: (s["source"], s["shard"])):
        if s["tokens"] > 0 and s["source"] in targets:
            by_source.setdefault(s["source"], []).append(s)
    names = sorted(by_source)
    most = [-(-sum(targets[n][1] * s["tokens"] for s in by_source[n]) // block) for n in names]
    seats = sainte_lague([targets[n][0] for n in names], total // block, most)
    out = []
    for name, n in zip(names, seats, strict=True):
        own = by_source[name]
        room = [-(-targets[name][1] * s["tokens"] // block) for s in own]
        for s, k in zip(own, sainte_lague([float(s["tokens"]) for s in own], n, room), strict=True):
            out.append(s | {"wanted": min(k * block, targets[name][1] * s["tokens"]), "repeats": targets[name][1]})
    return out


def mixture(documents: DataFrame, mix: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, tokens, copies: the documents of the mixture. ``total`` tokens, by default as many as the listed sources have.

    A source has a shard for every BLOCKS_PER_SHARD blocks of its tokens, one at least, at every size of the corpus. Of a source listed twice the first row by share counts; null shares and repeats count as 0. Documents without a source, without tokens
    or of sources not listed are left out. What a source can't fill goes to the others by their quotients.
    """
    listed = mix.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))).alias("t"))
    targets = {r["source"]: (r["t"]["share"], r["t"]["repeats"]) for r in listed.collect()}
    sized = cut_lineage(counted(documents.join(F.broadcast(listed.select("source")), "source", "left_semi"), vocabulary).filter("tokens > 0"))
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    everything = sum(have.values())
    total = everything if total is None else total
    block = max(1, -(-total // BLOCKS))
    spark = documents.sparkSession
    shard_of = spark.createDataFrame([(s, max(1, n // (BLOCKS_PER_SHARD * block))) for s, n in have.items()], "source string, parts long")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # the upper bits of the order are a part of its own, so that running sums are taken per part and the parts chained by one row each
    part = F.shiftrightunsigned(order, 64 - (PARTS - 1).bit_length()).cast("int")
    part = F.pmod(part + F.lit(PARTS // 2), F.lit(PARTS))
    placed = sized.join(F.broadcast(shard_of), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("parts")).cast("int")).withColumn("part", part)
    sums = cut_lineage(placed.groupBy("source", "shard", "part").agg(F.sum("tokens").alias("n")))  # at most BLOCKS / BLOCKS_PER_SHARD + sources shards, PARTS of each
    shards = [r.asDict() for r in sums.groupBy("source", "shard").agg(F.sum("n").alias("tokens")).collect()]
    wanted = [(s["source"], s["shard"], s["tokens"], s["wanted"], s["repeats"]) for s in quotas(shards, targets, total, block)]
    quota = spark.createDataFrame(wanted, "source string, shard int, shard_tokens long, wanted long, repeats int")
    earlier = F.sum("n").over(W.partitionBy("source", "shard").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    chained = sums.withColumn("earlier", earlier).drop("n").join(F.broadcast(quota), ["source", "shard"])
    drawn = placed.join(chained, ["source", "shard", "part"])
    before = F.col("earlier") + F.sum("tokens").over(W.partitionBy("source", "shard", "part").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    passes = F.floor(F.col("wanted") / F.col("shard_tokens"))
    more = (before < F.col("wanted") - passes * F.col("shard_tokens")).cast("int")
    copies = F.least(F.col("repeats"), passes + more).cast("int")
    return drawn.withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(documents: DataFrame, mix: DataFrame, **options) -> DataFrame:
    """source, target_share, actual_share, tokens, documents of each listed source; what has no documents has share 0."""
    mixed = mixture(documents, mix, **options)
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    listed = mix.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = listed.join(used, "source", "left").fillna(0, ["tokens", "documents"])
    whole = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # one row for each listed source
    return joined.select("source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "tokens", "documents")
