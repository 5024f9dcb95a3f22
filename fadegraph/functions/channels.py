"""Channels of edges: decay per hour, reinforcement, and whether pruning may remove them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel, decay per hour, reinforcement, prunable.
CHANNELS = {
    "derives_de": (0.0, 0.40, False),
    "causal": (0.0001, 0.50, True),
    "trail": (0.001, 0.30, True),
    "alarm": (0.005, 0.35, True),
    "semantic_sim": (0.02, 0.20, True),
    "episodic": (0.05, 0.10, True),
    "reasoning": (0.08, 0.15, True),
}
CUSTOM = (0.01, 0.20, True)
PROVENANCES = ("human", "ai_inferred", "ai_validated", "automated")
KINDS = ("entity", "concept", "event", "measurement", "procedure", "warning")
PRUNE_THRESHOLD = 0.05


def canonical(channel: Column) -> Column:
    """A channel's name, however its letters, blanks and underscores are written."""
    bare = F.regexp_replace(F.lower(channel), r"[_\s]+", "")
    return reduce(lambda c, name: c.when(bare == name.replace("_", ""), name), list(CHANNELS)[1:], F.when(bare == "derivesde", "derives_de")).otherwise(bare)


def _lookup(channel: Column, i: int) -> Column:
    items = list(CHANNELS.items())
    head = F.when(channel == items[0][0], F.lit(items[0][1][i]))
    return reduce(lambda c, kv: c.when(channel == kv[0], F.lit(kv[1][i])), items[1:], head).otherwise(F.lit(CUSTOM[i]))


def tau(channel: Column) -> Column:
    """Decay per hour."""
    return _lookup(channel, 0)


def delta(channel: Column) -> Column:
    """What one reinforcement adds."""
    return _lookup(channel, 1)


def prunable(channel: Column) -> Column:
    """Whether a dead edge of the channel may be removed."""
    return _lookup(channel, 2)


def is_known(channel: str) -> bool:
    """Whether a name is a channel."""
    bare = channel.lower().replace("_", "")
    return bare in {c.replace("_", "") for c in CHANNELS} or (channel.startswith("custom:") and channel[7:].isdigit())
