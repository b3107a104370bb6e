"""Detection queries, declared: which packets, by what key, counting what, over which threshold."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TelemetryQuery:
    """A query over windows of packets; expressions are SQL over the packet columns.

    where: packets that count. key: name and expression of the grouping columns. sums: name and expression of what is added up
    (integers). elements: columns that are counted once each (with the key) in a window, as `distinct`. having: condition on
    a window's sums. output: columns of the key that a hit is reported by; fewer than the key make a set.
    """

    name: str
    where: str
    key: tuple[tuple[str, str], ...]
    having: str
    sums: tuple[tuple[str, str], ...] = ()
    elements: tuple[str, ...] = ()
    distinct: str | None = None
    output: tuple[str, ...] | None = None

    @property
    def keys(self) -> list[str]:
        return [x for x, _ in self.key]

    @property
    def measures(self) -> list[str]:
        return [x for x, _ in self.sums] + ([self.distinct] if self.distinct else [])

    def with_threshold(self, having: str) -> TelemetryQuery:
        return replace(self, having=having)


def new_tcp_connections(threshold: int = 87) -> TelemetryQuery:
    """Destinations of many connection attempts."""
    return TelemetryQuery("new_tcp_connections", "proto = 6 AND tcp_flag = 2", (("dst_ip", "dst_ip"),), f"conns >= {threshold}", sums=(("conns", "1"),))


def ssh_brute(threshold: int = 10) -> TelemetryQuery:
    """Destinations that many sources send packets of one size to, on port 22."""
    return TelemetryQuery(
        "ssh_brute", "proto = 6 AND dst_port = 22", (("dst_ip", "dst_ip"), ("size", "size")), f"sources >= {threshold}",
        elements=("src_ip",), distinct="sources", output=("dst_ip",),
    )


def superspreader(threshold: int = 249) -> TelemetryQuery:
    """Sources that send to many destinations."""
    return TelemetryQuery("superspreader", "true", (("src_ip", "src_ip"),), f"dsts >= {threshold}", elements=("dst_ip",), distinct="dsts")


def port_scan(threshold: int = 55) -> TelemetryQuery:
    """Sources that try many ports."""
    return TelemetryQuery("port_scan", "proto = 6", (("src_ip", "src_ip"),), f"ports >= {threshold}", elements=("dst_port",), distinct="ports")


def ddos(threshold: int = 174) -> TelemetryQuery:
    """Destinations that many sources send to."""
    return TelemetryQuery("ddos", "true", (("dst_ip", "dst_ip"),), f"srcs >= {threshold}", elements=("src_ip",), distinct="srcs")


def syn_flood(threshold: int = 49) -> TelemetryQuery:
    """Hosts with more SYN and FIN-ACK than ACK packets, of those that were sent a SYN; a FIN-ACK counts for its source."""
    return TelemetryQuery(
        "syn_flood", "proto = 6 AND tcp_flag IN (2, 16, 17)", (("host", "CASE WHEN tcp_flag = 17 THEN src_ip ELSE dst_ip END"),),
        f"syn > 0 AND syn + synack - ack >= {threshold}",
        sums=tuple((name, f"CASE WHEN tcp_flag = {flag} THEN 1 ELSE 0 END") for name, flag in (("syn", 2), ("synack", 17), ("ack", 16))),
    )


def completed_flow(threshold: int = 60) -> TelemetryQuery:
    """Destinations with more connections opened than closed, of those with any opened."""
    return TelemetryQuery(
        "completed_flow", "proto = 6 AND (tcp_flag = 2 OR tcp_flag % 2 = 1)", (("dst_ip", "dst_ip"),), f"opened > 0 AND opened - closing >= {threshold}",
        sums=(("opened", "CASE WHEN tcp_flag = 2 THEN 1 ELSE 0 END"), ("closing", "CASE WHEN tcp_flag % 2 = 1 THEN 1 ELSE 0 END")),
    )


def slowloris(least_bytes: int = 7500, ratio: float = 0.004) -> TelemetryQuery:
    """Destinations with many connections for the bytes they carry."""
    return TelemetryQuery(
        "slowloris", "proto = 6", (("dst_ip", "dst_ip"),), f"bytes >= {least_bytes} AND conns > 0 AND CAST(conns AS DOUBLE) / bytes >= {ratio}",
        sums=(("bytes", "size"),), elements=("src_ip", "src_port"), distinct="conns",
    )


#: The eight queries with thresholds for half-second windows of a backbone link.
LIBRARY = (new_tcp_connections, ssh_brute, superspreader, port_scan, ddos, syn_flood, completed_flow, slowloris)
