"""Raw Ethernet frames into packet columns; tunnels into outer and inner packets.

Header fields lie at offsets that depend on other fields. As built-in expressions that makes a tree which
no longer compiles (measured: minutes for 60,000 frames), so frames of an Arrow batch are read together in
numpy: one array operation a field for all frames. One pass gives parsed fields and, for what can't be
parsed, an error number (see names.CAPTURE_ERRORS).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.addresses import ICMP, ICMPV6, TCP, UDP

IPV4, IPV6, ETHERNET = 0x0800, 0x86DD, 0x6558
GRE = 47
VXLAN_PORT, GENEVE_PORT, WIREGUARD_PORT = 4789, 6081, 51820
MALFORMED, OUT_OF_BOUNDS, NO_ETHER_TYPE, NO_PROTOCOL = 1, 2, 3, 4
FIELDS = "error int, ether_type int, src_mac string, src_ip binary, dst_ip binary, proto int, src_port int, dst_port int, icmp_type int, icmp_code int, tcp_flags int, dscp int, ecn int, ttl int, flow_label int, l4_offset int, payload_offset int, has_payload boolean"


class Frames:
    """Frames as ranges of one buffer; numbers at offsets of all of them at once."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = np.append(data, np.zeros(1, np.uint8)), start, np.maximum(end, start)
        self.size = self.end - self.start

    @classmethod
    def of(cls, column: pa.Array) -> "Frames":
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(data, offsets[:-1], offsets[1:])

    def number(self, at, n: int = 1) -> np.ndarray:
        """n bytes from an offset on; what lies behind a frame's end reads 0."""
        out = np.zeros(len(self.start), np.int64)
        for i in range(n):
            place = self.start + at + i
            out = (out << 8) | np.where(place < self.end, self.data[np.minimum(place, len(self.data) - 1)], 0)
        return out

    def binary(self, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a : a + k] for a, k in zip((self.start + at).tolist(), n.tolist())]

    def inside(self, at: np.ndarray) -> "Frames":
        return Frames(self.data[:-1], np.minimum(self.start + at, self.end), self.end)


def decoded(f: Frames, length: np.ndarray) -> dict[str, np.ndarray | list]:
    """All fields of the frames; length is that on the wire, for the payload test."""
    ether = f.number(12, 2)
    v4, v6 = ether == IPV4, ether == IPV6
    first = f.number(14)
    header = np.where(v4, (first & 15) * 4, 40)
    proto = np.where(v4, f.number(23), np.where(v6, f.number(20), 0))
    l4 = 14 + header
    needs = np.select([proto == TCP, proto == UDP], [20, 8], 4)
    wrong = [f.size < 14, ~v4 & ~v6, f.size < np.where(v4, 34, 54), ((first & 0xF0) != np.where(v4, 0x40, 0x60)) | (v4 & (header < 20)), ~np.isin(proto, (TCP, UDP, ICMP, ICMPV6)), f.size < l4 + needs]
    error = np.select(wrong, [OUT_OF_BOUNDS, NO_ETHER_TYPE, OUT_OF_BOUNDS, MALFORMED, NO_PROTOCOL, OUT_OF_BOUNDS], 0)
    tos = np.where(v4, f.number(15), (f.number(14, 2) >> 4) & 255)
    ports, icmp = np.isin(proto, (TCP, UDP)), np.isin(proto, (ICMP, ICMPV6))
    payload_at = l4 + np.where(proto == TCP, (f.number(l4 + 12) >> 4) * 4, needs)
    width = np.where(v4, 4, 16)
    good = error == 0
    nothing = np.zeros(len(good), bool)
    numbers = {
        "ether_type": (ether, good),
        "proto": (proto, good),
        "src_port": (np.where(ports, f.number(l4, 2), 0), good),
        "dst_port": (np.where(ports, f.number(l4 + 2, 2), 0), good),
        "icmp_type": (f.number(l4), good & icmp),
        "icmp_code": (f.number(l4 + 1), good & icmp),
        "tcp_flags": (np.where(proto == TCP, f.number(l4 + 13), 0), good),
        "dscp": (tos >> 2, good),
        "ecn": (tos & 3, good),
        "ttl": (np.where(v4, f.number(22), f.number(21)), good),
        "flow_label": (f.number(14, 4) & 0xFFFFF, good & v6),
        "l4_offset": (l4, good),
        "payload_offset": (payload_at, good),
        "error": (error, ~good),
    }
    out = {k: pa.array(v.astype(np.int32), mask=~ok) for k, (v, ok) in numbers.items()}
    mac = f.binary(nothing + 6, nothing + 6)
    out["src_mac"] = pa.array([m.hex(":") for m in mac], pa.string(), mask=~good)
    out["src_ip"] = pa.array(f.binary(np.where(v4, 26, 22), width), pa.binary(), mask=~good)
    out["dst_ip"] = pa.array(f.binary(np.where(v4, 30, 38), width), pa.binary(), mask=~good)
    out["has_payload"] = pa.array(length > payload_at, mask=~good)
    return out


def _length(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy()


def decode(frames: DataFrame, frame: str = "frame", length: str = "len") -> DataFrame:
    """Adds error and all fields; error is null where the frame is good, the fields where it isn't."""
    fields = StructType.fromDDL(FIELDS)
    frames = frames.drop(*[c for c in fields.names if c in frames.columns])
    schema = StructType(frames.schema.fields + fields.fields)

    def task(batches):
        for batch in batches:
            made = decoded(Frames.of(batch.column(frame)), _length(batch, length))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[c] for c in fields.names)], names=schema.names)

    return frames.mapInArrow(task, schema)


def parsed(decoded_frames: DataFrame) -> DataFrame:
    return decoded_frames.filter("error IS NULL").drop("error")


def rejects(decoded_frames: DataFrame) -> DataFrame:
    """What couldn't be parsed, with its error number."""
    return decoded_frames.filter("error IS NOT NULL").drop(*[c for c in StructType.fromDDL(FIELDS).names if c != "error"])


def is_tunnel(proto: Column, source: Column, target: Column, vxlan: int = VXLAN_PORT, geneve: int = GENEVE_PORT, wireguard: int = WIREGUARD_PORT) -> Column:
    ports = (vxlan, geneve, wireguard)
    return (proto == GRE) | (proto.isin(TCP, UDP) & (source.isin(*ports) | target.isin(*ports)))


def decapsulate(frames: DataFrame, frame: str = "frame", length: str = "len") -> DataFrame:
    """Packets keyed on the inner tuple, with outer_src_ip, outer_dst_ip, tunnel_type and tunnel_vni.

    VXLAN and Geneve (with options of any length) are opened; all else stays as it is, without outer ends.
    error is that of the innermost frame.
    """
    fields = StructType.fromDDL(FIELDS + ", outer_src_ip binary, outer_dst_ip binary, tunnel_type string, tunnel_vni int")
    frames = frames.drop(*[c for c in fields.names if c in frames.columns])
    schema = StructType(frames.schema.fields + fields.fields)

    def task(batches):
        for batch in batches:
            f, size = Frames.of(batch.column(frame)), _length(batch, length)
            outer = decoded(f, size)
            plain = {c: pc.fill_null(outer[c], -1).to_numpy() for c in ("proto", "dst_port", "l4_offset")}
            body = np.maximum(plain["l4_offset"], 0) + 8
            udp = plain["proto"] == UDP
            vxlan = udp & (plain["dst_port"] == VXLAN_PORT)
            geneve = udp & (plain["dst_port"] == GENEVE_PORT) & (f.number(body + 2, 2) == ETHERNET)
            opened = vxlan | geneve
            at = np.where(opened, body + 8 + np.where(geneve, (f.number(body) & 63) * 4, 0), 0)
            made = decoded(f.inside(at), size - at)
            made["outer_src_ip"] = pc.if_else(pa.array(opened), outer["src_ip"], pa.scalar(None, pa.binary()))
            made["outer_dst_ip"] = pc.if_else(pa.array(opened), outer["dst_ip"], pa.scalar(None, pa.binary()))
            made["tunnel_type"] = pa.array(np.where(vxlan, "vxlan", "geneve").tolist(), pa.string(), mask=~opened)
            made["tunnel_vni"] = pa.array(f.number(body + 4, 3).astype(np.int32), mask=~opened)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[c] for c in fields.names)], names=schema.names)

    return frames.mapInArrow(task, schema)
