"""Names of numeric fields as small fixed dictionaries, and columns that look them up.

A dictionary becomes a literal map, so a lookup is one built-in expression inside the stage it is used in.
"""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of IP protocols, by number from 0 on, and the last three.
_PROTOCOLS = """
hopopt icmp igmp ggp ipv4 stream tcp cbt egp igp bbn-rcc-mon nvp-ii pup argus emcon xnet chaos udp mux dcn-meas hmp prm
idp trunk-1 trunk-2 leaf-1 leaf-2 rdp irtp tp4 netblt mfe-nsp merit-inp dccp 3pc idpr xtp ddp idpr-cmtp tp++ il ipv6 sdrp
ipv6-route ipv6-frag idrp rsvp gre dsr bna esp ah inlsp swipe narp mobile tlsp skip icmpv6 ipv6-nonxt ipv6-opts
any-host-internal cftp any-local-network sat-expak kryptolan rvd ippc any-distributed-file-system sat-mon visa ipcv cpnx
cphb wsn pvp br-sat-mon sun-nd wb-mon wb-expak iso-ip vmtp secure-vmtp vines ttp nsfnet-igp dgp tcf eigrp ospfigp
sprite-rpc larp mtp ax.25 ipip micp scc-sp etherip encap any-private-encryption-scheme gmtp ifmp pnni pim aris scps qnx
active-networks ipcomp snp compaq-peer ipx-in-ip vrrp pgm any-0-hop-protocol l2tp ddx iatp stp srp uti smp sm ptp
isis-over-ipv4 fire crtp crudp sscopmce iplt sps pipe sctp fc rsvp-e2e-ignore mobility-header udplite mpls-in-ip manet
hip shim6 wesp rohc ethernet-in-ipv4 aggfrag
""".split()
PROTOCOLS = dict(enumerate(_PROTOCOLS)) | {253: "test1", 254: "test2", 255: "reserved"}

# Ether types.
ETHER_TYPES = {0x0060: "loop", 0x0800: "ipv4", 0x0806: "arp", 0x6558: "ethernet", 0x8100: "vlan", 0x86DD: "ipv6", 0x88A8: "qinq", 0x88E5: "macsec", 0x88E7: "pbb", 0x88F5: "mvrp", 0x8906: "fibre-channel", 0x8915: "infiniband", 0x9000: "loopback", 0x9100: "qinq-1", 0x9200: "qinq-2", 0x9300: "qinq-3"}

# Differentiated services code points and congestion notification.
DSCP = {0: "df", 1: "le", 8: "cs1", 10: "af11", 12: "af12", 14: "af13", 16: "cs2", 18: "af21", 20: "af22", 22: "af23", 24: "cs3", 26: "af31", 28: "af32", 30: "af33", 32: "cs4", 34: "af41", 36: "af42", 38: "af43", 40: "cs5", 44: "voice", 45: "nqb", 46: "ef", 48: "cs6", 56: "cs7"}
ECN = {0: "non-ect", 1: "ect1", 2: "ect0", 3: "ce"}

# TCP connection states, by number.
STATES = dict(enumerate(["closed", "listen", "syn_sent", "syn_received", "established", "fin_wait_1", "fin_wait_2", "close_wait", "closing", "last_ack", "time_wait"]))

# TCP flags from the lowest bit on.
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")

# Why a flow record ends, by number.
END_REASONS = {0: "reserved", 1: "idle timeout", 2: "active timeout", 3: "end of Flow detected", 4: "forced end", 5: "lack of resources"}

# Why a packet couldn't be counted, by number.
CAPTURE_ERRORS = {0: "internal error", 1: "malformed header", 2: "out of bounds", 3: "unsupported ether type", 4: "unsupported protocol", 5: "flow event dropped (ring buffer full)", 6: "per-cpu scratch unavailable", 7: "flow map insert failed"}
LEVELS = {1: "error", 2: "warn", 3: "info", 4: "debug", 5: "trace"}

# ICMP types of IPv4 and of IPv6.
ICMP_TYPES = {0: "echo_reply", 3: "destination_unreachable", 4: "source_quench", 5: "redirect", 8: "echo_request", 9: "router_advertisement", 10: "router_selection", 11: "time_exceeded", 12: "parameter_problem", 13: "timestamp", 14: "timestamp_reply", 15: "information_request", 16: "information_reply", 17: "address_mask_request", 18: "address_mask_reply", 40: "photuris", 42: "extended_echo_request", 43: "extended_echo_reply"}
ICMPV6_TYPES = {1: "destination_unreachable", 2: "packet_too_big", 3: "time_exceeded", 4: "parameter_problem", 128: "echo_request", 129: "echo_reply", 130: "mld_query", 131: "mld_report", 132: "mld_done", 133: "router_solicitation", 134: "router_advertisement", 135: "neighbor_solicitation", 136: "neighbor_advertisement", 137: "redirect", 138: "router_renumbering", 139: "node_information_query", 140: "node_information_response", 141: "inverse_neighbor_discovery_solicitation", 142: "inverse_neighbor_discovery_advertisement", 143: "mldv2_multicast_listener_report", 144: "home_agent_address_discovery_request", 145: "home_agent_address_discovery_reply", 146: "mobile_prefix_solicitation", 147: "mobile_prefix_advertisement", 148: "certification_path_solicitation", 149: "certification_path_advertisement", 150: "experimental_mobility_protocols", 151: "multicast_router_advertisement", 152: "multicast_router_solicitation", 153: "multicast_router_termination", 154: "fmipv6_messages", 155: "rpl_control_message", 156: "mpl_control_message", 157: "duplicate_address_request_code_suffix", 158: "duplicate_address_confirmation_code_suffix", 160: "extended_echo_request", 161: "extended_echo_reply"}

# ICMP codes by type, from 0 on; types without named codes have an empty name for code 0.
_EXTENDED_REPLY = ["no_error", "malformed_query", "no_such_interface", "no_such_table_entry", "multiple_interfaces_satisfy_query"]
_SUFFIXES = ["dar_message", "edar_message_with_64_bit_rovr_field", "edar_message_with_128_bit_rovr_field", "edar_message_with_192_bit_rovr_field", "edar_message_with_256_bit_rovr_field"]
_ICMP_CODES = {
    3: ["net_unreachable", "host_unreachable", "protocol_unreachable", "port_unreachable", "fragmentation_needed", "source_route_failed", "destination_network_unknown", "destination_host_unknown", "source_host_isolated", "network_administratively_prohibited", "host_administratively_prohibited", "network_unreachable_for_tos", "host_unreachable_for_tos", "communication_administratively_prohibited", "host_precedence_violation", "precedence_cutoff_in_effect"],
    5: ["redirect_for_network", "redirect_for_host", "redirect_for_tos_and_network", "redirect_for_tos_and_host"],
    11: ["ttl_expired", "fragment_reassembly_time_exceeded"],
    12: ["pointer_indicates_error", "missing_required_option", "bad_length"],
    40: ["bad_spi", "authentication_failed", "decompression_failed", "decryption_failed", "need_authentication", "need_authorization"],
    42: ["no_error"],
    43: _EXTENDED_REPLY,
}
_ICMPV6_CODES = {
    1: ["no_route_to_destination", "communication_with_destination_administratively_prohibited", "beyond_scope_of_source_address", "address_unreachable", "port_unreachable", "source_address_failed_ingress_egress_policy", "reject_route_to_destination", "error_in_source_routing_header", "headers_too_long", "error_in_p_route"],
    3: ["hop_limit_exceeded", "fragment_reassembly_time_exceeded"],
    4: ["erroneous_header_field_encountered", "unrecognized_next_header_type_encountered", "unrecognized_ipv6_option_encountered", "ipv6_first_fragment_has_incomplete_ipv6_header_chain", "sr_upper_layer_header_error", "unrecognized_next_header_type_encountered_by_intermediate_node", "extension_header_too_big", "extension_header_chain_too_long", "too_many_extension_headers", "too_many_options_in_extension_header", "option_too_big"],
    138: ["router_renumbering_command", "router_renumbering_result"],
    139: ["data", "name", "name_or_address"],
    140: ["successful_response", "responding_node_is_the_node_queried", "query_is_recognized_but_the_requested_info_is_unavailable", "query_is_not_recognized"],
    157: _SUFFIXES,
    158: _SUFFIXES,
    160: ["no_error"],
    161: _EXTENDED_REPLY,
}


def _codes(types: dict[int, str], named: dict[int, list[str]]) -> dict[int, str]:
    """Names by type * 256 + code."""
    return {t * 256 + code: name for t in types for code, name in enumerate(named.get(t, [""]))}


ICMP_CODES = _codes(ICMP_TYPES, _ICMP_CODES) | {9 * 256 + 16: "does_not_route_common_traffic"}
ICMPV6_CODES = _codes(ICMPV6_TYPES, _ICMPV6_CODES) | {138 * 256 + 255: "sequence_number_reset"}

# The ICMP type that answers each type.
ICMP_ANSWERS = {0: 8, 8: 0, 9: 10, 10: 9, 13: 14, 14: 13, 15: 16, 16: 15, 17: 18, 18: 17}
ICMPV6_ANSWERS = {k: k ^ 1 for k in (128, 129, 130, 131, 144, 145, 146, 147, 148, 149, 160, 161)} | {133: 134, 134: 133, 135: 136, 136: 135, 139: 140, 140: 139, 141: 142, 142: 141, 151: 152, 152: 151}


def lookup(number: Column, names: dict) -> Column:
    """The name of a number; null if there is none."""
    entries = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.try_element_at(entries, number.cast("int"))


def protocol_name(number: Column) -> Column:
    return F.coalesce(lookup(number, PROTOCOLS), number.cast("string"))


def dscp_name(number: Column, on_span: bool = True) -> Column:
    """Unknown code points read ``df`` on spans and their decimal in filters."""
    return F.coalesce(lookup(number, DSCP), F.lit("df") if on_span else number.cast("string"))


def ecn_name(number: Column, on_span: bool = True) -> Column:
    return F.coalesce(lookup(number, ECN), F.lit("non-ect") if on_span else number.cast("string"))


def icmp_type_name(number: Column, version: Column) -> Column:
    return F.when(version == 4, lookup(number, ICMP_TYPES)).when(version == 6, lookup(number, ICMPV6_TYPES))


def icmp_code_name(number: Column, code: Column, version: Column) -> Column:
    both = number * 256 + code
    return F.when(version == 4, lookup(both, ICMP_CODES)).when(version == 6, lookup(both, ICMPV6_CODES))


def flag_tags(flags: Column) -> Column:
    """Names of the set flags, lowest bit first."""
    tags = [F.when(flags.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)) for bit, name in enumerate(FLAGS)]
    return F.filter(F.array(*tags), lambda tag: tag.isNotNull())


def sql_case(column: str, names: dict) -> str:
    """The same lookup as SQL text."""
    quoted = {k: f"'{v}'" if isinstance(v, str) else v for k, v in names.items()}
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in quoted.items()) + " END"
