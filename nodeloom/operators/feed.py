"""Mini-batches of training ids with their sampled neighbourhoods and input features.

A sampler is any ``sampler(edges, seeds) -> (blocks, inputs)``: seeds are (batch_id, node_id),
blocks hold (batch_id, layer, src, dst), inputs are (batch_id, node_id). The factories below
bind the library's samplers to that form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators import gather, ordering, sampling
from nodeloom.plans.store import materialize

Sampler = Callable[[DataFrame, DataFrame], "tuple[DataFrame, DataFrame]"]


@dataclass
class MiniBatches:
    """Seeds, sampled edges, input nodes, and the inputs' feature rows, all keyed by batch."""

    seeds: DataFrame
    blocks: DataFrame
    inputs: DataFrame
    features: DataFrame


def neighbor_sampler(fanouts: Sequence[int], seed: int = 0, epoch: int = 0, index: sampling.EdgeIndex | None = None) -> Sampler:
    return lambda edges, seeds: sampling.sample_neighbors(edges, seeds, fanouts, seed, epoch, index=index)


def group_sampler(groups: DataFrame, fanouts: Sequence[int], seed: int = 0, epoch: int = 0) -> Sampler:
    return lambda edges, seeds: sampling.sample_group_neighbors(edges, groups, seeds, fanouts, seed, epoch)


def layer_sampler(nodes_per_layer: Sequence[int], seed: int = 0, mode: str = "importance", replace: bool = False) -> Sampler:
    def sample(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
        weighted = materialize(sampling.edge_weights_by_dst(edges), "weighted")
        return sampling.sample_layerwise(weighted, seeds, nodes_per_layer, seed, mode, replace)

    return sample


def cluster_sampler() -> Sampler:
    """Every seed of a batch is a member; one layer, the edges among the members."""

    def sample(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
        block = sampling.induced_subgraph(edges, seeds)
        return block.withColumn("layer", F.lit(0).cast("bigint")).select("batch_id", "layer", "src", "dst"), seeds.select("batch_id", "node_id")

    return sample


def minibatch_feed(edges: DataFrame, features: DataFrame, seeds: DataFrame, sampler: Sampler) -> MiniBatches:
    """Sample around ``seeds`` (batch_id, node_id) and fetch the features of all input nodes."""
    seeds = seeds.select("batch_id", "node_id")
    blocks, inputs = sampler(edges, seeds)
    return MiniBatches(seeds, blocks, inputs, gather.gather_batches(inputs, features))


def batches_of(ids: DataFrame, size: int, seed: int = 0, epoch: int = 0, *, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """(batch_id, node_id) of an epoch, the seeds of :func:`minibatch_feed`."""
    return ordering.make_batches(ids, size, seed, epoch, shuffle=shuffle, drop_last=drop_last).select("batch_id", "node_id")


def minibatch_feed_hetero(typed_edges: DataFrame, features: DataFrame, offsets: DataFrame, seeds: DataFrame,
                          fanouts: Sequence[int], seed: int = 0, epoch: int = 0) -> MiniBatches:
    """The typed form: seeds are (batch_id, ntype, node_id), features one table of global rows."""
    blocks, inputs = sampling.sample_neighbors_hetero(typed_edges, seeds, fanouts, seed, epoch)
    return MiniBatches(seeds, blocks, inputs, gather.gather_features_hetero(inputs, features, offsets))
