"""Table schemas, keys and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame

EVENTS = (
    "id long, source_file string, line_no long, ts timestamp, ts_raw string, event_type string, flow_id long, community_id string, src_ip string, src_port int, dest_ip string, dest_port int, "
    "proto string, app_proto string, flow_start timestamp, flow_end timestamp, ssh_client_software string, http_method string, http_url string, alert_sid long, alert_signature string, alert_severity int, raw string"
)
PACKETS = (
    "pcap_path string, packet_number long, packet_epoch double, src_ip string, src_port int, dest_ip string, dest_port int, protocol string, tcp_stream long, frame_length long, "
    "http_method string, http_uri string, http_status int, dns_query string, is_retransmission boolean"
)
#: What identifies a row of each stored table, and the columns whose partitions a rerun replaces.
KEYS = {
    "files": ("source_file",), "events": ("source_file", "line_no"), "sessions": ("session_id",), "session_flows": ("session_id", "flow_id"), "findings": ("finding_id",), "cases": ("case_id",), "case_findings": ("case_id", "finding_id"),
    "anomaly_windows": ("src_ip", "window_start", "window_seconds"), "anomaly_baselines": ("scope", "src_ip", "metric", "window_seconds"), "anomaly_findings": ("finding_id",), "anomaly_events": ("finding_id", "event_id"),
    "pcap_evidence": ("case_id", "pcap_path", "packet_number"), "case_eve_events": ("case_id", "event_id"),
}


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, names, table: str = "table") -> DataFrame:
    """df, if it has the columns; else an error that names those missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{table} lacks {', '.join(missing)}")
    return df
