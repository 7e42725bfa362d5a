"""Fixed values of the sampling model, and the engine's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Fixed values.
LATENCY_BOUNDS_US = [1000, 5000, 20000, 50000, 200000, 500000, 2000000]
SERVICE_IDS = {
    "frontend": 0,
    "productcatalogservice": 1,
    "cartservice": 2,
    "currencyservice": 3,
    "checkoutservice": 4,
    "paymentservice": 5,
    "shippingservice": 6,
    "emailservice": 7,
    "recommendationservice": 8,
    "adservice": 9,
    "loadgenerator": 10,
}
UNKNOWN_SERVICE_ID = 255
SKETCH_SEEDS = [0x9E3779B1, 0x517CC1B7, 0x6C62272E, 0x2E1B2138]
SKETCH_COLUMNS = 512
ARMS = 256
REWARDS = {"error": 1.0, "extreme_slow": 0.9, "very_slow": 0.8, "slow": 0.5, "complex": 0.4, "moderate": 0.2, "routine": 0.0}
VALUES = {"error": 1.0, "very_slow": 0.8, "slow": 0.5, "complex": 0.4, "moderate": 0.2, "routine": 0.1, "unknown": 0.0}
SLOW_MS = {"extreme_slow": 2000, "very_slow": 500, "slow": 200, "moderate": 50}
COMPLEX_SERVICES = 4
REWARD_NOVELTY = 0.5
SKETCH_BYTES = 8192
BANDIT_BYTES = 38912
THOMPSON_BYTES = 4096
CHECKPOINT_BYTES = 50208


PREFIX = "KESTRACE_"


@dataclass(frozen=True)
class EngineConfig:
    """Settings of the sampler.

    from_environment reads them from variables of the same names in capitals with PREFIX,
    else without it. Ports and the endpoint are settings that transports around the engine use.
    """

    service_name: str = "unknown"
    listen_port: int = 4317
    http_port: int = 8081
    forward_endpoint: str = "otel-collector:4317"
    metrics_interval_s: float = 10.0
    checkpoint_dir: str = ""
    alpha: float = 1.0
    threshold: float = 0.5
    confidence: int = 10
    force_errors: bool = True
    decay_factor: float = 0.9
    decay_interval_s: int = 300
    queue_capacity: int = 4096
    drain_batch: int = 256
    cache_traces: int = 50000
    decision_log: int = 2000
    checkpoint_interval_s: int = 60
    poll_interval_s: int = 30
    poll_limit: int = 30
    poll_lookback_s: int = 60
    seed: str = "0"

    @staticmethod
    def from_environment() -> EngineConfig:
        default = EngineConfig()
        found = {}
        for name, value in vars(default).items():
            text = os.environ.get(PREFIX + name.upper(), os.environ.get(name.upper()))
            if text is not None:
                found[name] = text.strip().lower() in ("1", "true", "yes") if isinstance(value, bool) else type(value)(text)
        return EngineConfig(**found)
