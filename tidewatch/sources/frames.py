"""Small decoders of single frames: addresses, ports, TCP, HTTP heads and DNS questions."""

from __future__ import annotations

import re
import struct
from ipaddress import ip_address
from typing import NamedTuple

#: Protocol numbers, Ethernet types, families of loopback headers, link types.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6", 132: "SCTP"}
IPV4, IPV6, TAGS = 0x0800, 0x86DD, (0x8100, 0x88A8)
FAMILIES = {2: IPV4, 10: IPV6, 24: IPV6, 28: IPV6, 30: IPV6}
NULL, ETHERNET, RAW, COOKED, LOOP, COOKED2, ONLY4, ONLY6 = 0, 1, (12, 14, 101), 113, 108, 276, 228, 229
HTTP_REQUEST = re.compile(rb"(GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH) ([^ \r\n]+) HTTP/\d")
HTTP_RESPONSE = re.compile(rb"HTTP/\d(?:\.\d)? (\d{3})\b")
FIN, SYN, ACK = 1, 2, 16


class Decoded(NamedTuple):
    src_ip: str | None = None
    src_port: int | None = None
    dest_ip: str | None = None
    dest_port: int | None = None
    protocol: str | None = None
    http_method: str | None = None
    http_uri: str | None = None
    http_status: int | None = None
    dns_query: str | None = None
    tcp_seq: int | None = None
    tcp_flags: int | None = None
    tcp_length: int | None = None


def network_layer(frame: bytes, link: int) -> tuple[int | None, int]:
    """Type of what a frame carries and where it begins; None for link types that aren't known."""
    kind, at = None, 0
    if link == ETHERNET and len(frame) >= 14:
        kind, at = int.from_bytes(frame[12:14]), 14
    elif link == COOKED and len(frame) >= 16:
        kind, at = int.from_bytes(frame[14:16]), 16
    elif link == COOKED2 and len(frame) >= 20:
        kind, at = int.from_bytes(frame[:2]), 20
    elif link in (NULL, LOOP) and len(frame) >= 4:
        family = int.from_bytes(frame[:4])
        kind, at = FAMILIES.get(family, FAMILIES.get(int.from_bytes(frame[:4], "little"))), 4
    elif link in (ONLY4, ONLY6):
        kind = IPV4 if link == ONLY4 else IPV6
    elif link in RAW and frame:
        kind = {4: IPV4, 6: IPV6}.get(frame[0] >> 4)
    while kind in TAGS and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4]), at + 4
    return kind, at


def dns_name(message: bytes) -> str | None:
    """The first question's name of a DNS message; None if there is none, or if it is cut."""
    if len(message) < 17 or not int.from_bytes(message[4:6]):
        return None
    labels, at = [], 12
    while at < len(message):
        size = message[at]
        if size == 0:
            return b".".join(labels).decode("ascii", "replace") or "<Root>"
        if size > 63 or at + 1 + size > len(message):
            return None
        labels.append(message[at + 1 : at + 1 + size])
        at += 1 + size
    return None


def decode_frame(frame: bytes, link: int = ETHERNET) -> Decoded:
    """What a frame says; the protocol is the highest one known. Addresses stay null where the link type or the network layer isn't known."""
    kind, at = network_layer(frame, link)
    if kind == IPV4 and len(frame) >= at + 20:
        number, body = frame[at + 9], at + (frame[at] & 15) * 4
        ends, until = (frame[at + 12 : at + 16], frame[at + 16 : at + 20]), int.from_bytes(frame[at + 2 : at + 4])
        whole = int.from_bytes(frame[at + 6 : at + 8]) & 0x1FFF == 0
        until = at + until if until else len(frame)  # left to the card: no total length
    elif kind == IPV6 and len(frame) >= at + 40:
        number, body, whole = frame[at + 6], at + 40, True
        ends, until = (frame[at + 8 : at + 24], frame[at + 24 : at + 40]), int.from_bytes(frame[at + 4 : at + 6])
        until = at + 40 + until if until else len(frame)
        while number in (0, 43, 60, 44) and len(frame) >= body + 8:
            whole = whole and not (number == 44 and int.from_bytes(frame[body + 2 : body + 4]) >> 3)
            number, body = frame[body], body + (8 if number == 44 else (frame[body + 1] + 1) * 8)
    else:
        return Decoded(protocol="ETH" if link == ETHERNET else None)
    src, dest = (str(ip_address(e)) for e in ends)
    name = PROTOCOL_NAMES.get(number, "IP")
    if not whole or number not in (6, 17, 132) or len(frame) < body + 4:
        return Decoded(src, None, dest, None, name)
    ports = struct.unpack_from(">HH", frame, body)
    if number == 6 and len(frame) >= body + 20:
        start = body + (frame[body + 12] >> 4) * 4
        return _tcp(Decoded(src, ports[0], dest, ports[1], name, tcp_seq=int.from_bytes(frame[body + 4 : body + 8]), tcp_flags=frame[body + 13], tcp_length=max(0, until - start)), frame[start:until])
    found = Decoded(src, ports[0], dest, ports[1], name)
    if number == 17 and (53 in ports or 5353 in ports) and (query := dns_name(frame[body + 8 : until])):
        return found._replace(protocol="DNS" if 53 in ports else "MDNS", dns_query=query)
    return found


def _tcp(found: Decoded, payload: bytes) -> Decoded:
    if request := HTTP_REQUEST.match(payload):
        return found._replace(protocol="HTTP", http_method=request[1].decode(), http_uri=request[2].decode("utf-8", "replace"))
    if response := HTTP_RESPONSE.match(payload):
        return found._replace(protocol="HTTP", http_status=int(response[1]))
    if 53 in (found.src_port, found.dest_port) and (query := dns_name(payload[2:])):
        return found._replace(protocol="DNS", dns_query=query)
    return found
