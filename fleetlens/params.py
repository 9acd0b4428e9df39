"""Every threshold of the detectors, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topology:
    """Sizes of the tensor-, pipeline- and (derived) data-parallel dimensions."""

    tp: int = 2
    pp: int = 2
    world_size: int = 8

    def __post_init__(self):
        if min(self.tp, self.pp, self.world_size) < 1:
            raise ValueError("TP, PP and world_size must be positive")
        if self.tp * self.pp > self.world_size:
            raise ValueError("TP * PP must not exceed world_size")
        if self.world_size % (self.tp * self.pp):
            raise ValueError("TP * PP must divide world_size")

    @property
    def dp(self) -> int:
        return self.world_size // (self.tp * self.pp)

    @classmethod
    def from_mapping(cls, cfg: dict) -> Topology:
        return cls(int(cfg.get("TP", 2)), int(cfg.get("PP", 2)), int(cfg.get("world_size", 8)))


@dataclass(frozen=True)
class HangLimits:
    stream_idle_s: float = 300.0
    stream_idle_high_s: float = 600.0
    collective_gap_s: float = 120.0
    watched: tuple[str, ...] = ("AllReduce", "AllGather", "Broadcast")
    operation_gap_s: float = 60.0
    send_recv_gap_s: float = 180.0
    point_to_point: tuple[str, ...] = ("Send", "Recv", "SendRecv")


@dataclass(frozen=True)
class SequenceLimits:
    lags: int = 10
    threshold: float = 2.0


@dataclass(frozen=True)
class AlertLimits:
    recurrence_s: int = 1200
    repeat_push_s: int = 86_400
    group_repeat_s: int = 3_600
    heartbeat_timeout_s: int = 1200


# One-sided critical values of the maximum-residual test, alpha = 0.05, n = 4..30
GRUBBS_CRITICAL = {
    4: 1.463, 5: 1.672, 6: 1.822, 7: 1.938, 8: 2.032, 9: 2.110, 10: 2.176,
    11: 2.234, 12: 2.285, 13: 2.331, 14: 2.371, 15: 2.409, 16: 2.443, 17: 2.475,
    18: 2.504, 19: 2.532, 20: 2.557, 21: 2.580, 22: 2.603, 23: 2.624, 24: 2.644,
    25: 2.663, 26: 2.681, 27: 2.698, 28: 2.714, 29: 2.730, 30: 2.745,
}

# Operation classes
OPERATION_CLASSES = {
    "collective": ("AllReduce", "AllGather", "Broadcast", "Reduce", "Scatter", "Gather"),
    "point_to_point": ("Send", "Recv", "SendRecv"),
    "synchronization": ("Barrier", "Wait", "Synchronize"),
}

# Seconds above which an operation counts as slow
SLOW_SECONDS = {"AllReduce": 5, "AllGather": 8, "Broadcast": 3, "Send": 15, "Recv": 15}
SLOW_SECONDS_DEFAULT = 10

# Lower bounds of the payload size buckets
SIZE_BUCKETS = {"small": 1024, "medium": 1024**2, "large": 10 * 1024**2, "huge": 100 * 1024**2}

# Numeric severity levels
SEVERITY_LEVELS = {
    "P0": 4, "CRITICAL": 4, "P1": 3, "HIGH": 3, "P2": 2, "WARNING": 2, "MEDIUM": 2,
    "P3": 1, "INFO": 1, "LOW": 1,
}

# Names of the transfer function codes
LINK_FUNCTIONS = {
    0: "ncclFuncBroadcast", 1: "ncclFuncReduce", 2: "ncclFuncAllGather",
    3: "ncclFuncReduceScatter", 4: "ncclFuncAllReduce", 5: "ncclFuncSendRecv",
    6: "ncclFuncSend", 7: "ncclFuncRecv", 8: "ncclNumFuncs",
}

# Forecast presets (history length, deviation threshold)
SEQUENCE_PRESETS = ((5, 1.0), (10, 2.0), (15, 3.0), (8, 2.5))
