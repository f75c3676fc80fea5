"""Ordered rule tables over properties, ducking, and network lists."""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liveops.functions.maps import update


@dataclass(frozen=True)
class Rule:
    """A pattern and what it does: set a level, or update the properties."""

    pattern: str
    level: int | None = None
    props: dict[str, str] = field(default_factory=dict)
    mode: str = "replace"


def load(lines) -> list[Rule]:
    """Rules from lines ``pattern level`` or ``pattern "key=value"``; # starts a comment."""
    out = []
    for line in lines:
        pattern, _, action = line.strip().partition(" ")
        action = action.strip()
        if not pattern or pattern.startswith("#"):
            continue
        if "=" in action:
            name, _, value = action.strip('"').partition("=")
            out.append(Rule(pattern, props={name.strip(): value.strip().strip('"')}))
        else:
            out.append(Rule(pattern, level=int(action)))
    return out


def apply(df: DataFrame, rules: list[Rule], key: str, level: str = "level",
          props: str | None = None) -> DataFrame:
    """Apply the rules in order where they match ``key``; a later rule acts on the result.

    Rules are a short configuration list, so they become one expression with
    compiled patterns and need no join.
    """
    new_level, new_props = F.col(level), F.col(props) if props else None
    for rule in rules:
        hit = F.col(key).rlike(rule.pattern)
        if rule.level is not None:
            new_level = F.when(hit, F.lit(rule.level)).otherwise(new_level)
        if rule.props and props:
            pairs = [F.lit(x) for kv in rule.props.items() for x in kv]
            new_props = F.when(
                hit, update(new_props, F.create_map(*pairs), rule.mode)
            ).otherwise(new_props)
    out = {level: new_level}
    if props:
        out[props] = new_props
    return df.withColumns(out)


def duck(streams: DataFrame, trigger, ducked, by: int, scope: str = "device") -> DataFrame:
    """Lower ducked roles by ``by`` while a trigger role plays on the device, or anywhere."""
    triggers = streams.where(F.col("role").isin(*trigger))
    if scope == "global":
        lowered = triggers.agg(F.count(F.lit(1)) > 0).scalar()
        rows = streams
    else:
        present = triggers.select("device").distinct().withColumn("_present", F.lit(True))
        rows = streams.join(present, "device", "left")
        lowered = F.coalesce(F.col("_present"), F.lit(False))
    out = rows.withColumn("ducked", lowered & F.col("role").isin(*ducked))
    return out.withColumn(
        "level", F.when(F.col("ducked"), F.col("level") - by).otherwise(F.col("level"))
    ).drop("_present")


def ipv4_hex(address) -> Column:
    return F.lpad(F.hex(address), 8, "0")


def in_networks(df: DataFrame, networks: list[str], address: Column) -> DataFrame:
    """Rows whose address lies in a listed prefix.

    ``address`` is hex text, 8 digits for IPv4 and 32 for IPv6. Prefixes of one
    length are one set lookup on the leading bits, whatever their number.
    """
    sets: dict[tuple[int, int], set[str]] = defaultdict(set)
    for text in networks:
        net = ipaddress.ip_network(text.strip(), strict=False)
        sets[net.max_prefixlen // 4, net.prefixlen].add(_lead(net))
    tests = []
    for (digits, length), leads in sets.items():
        whole, rest = divmod(length, 4)
        lead = F.upper(F.substring(address, 1, whole)) if whole else F.lit("")
        if rest:
            digit = F.conv(F.substring(address, whole + 1, 1), 16, 10).cast("int")
            lead = F.concat(lead, F.lit(":"), F.shiftright(digit, 4 - rest).cast("string"))
        tests.append((F.length(address) == digits) & lead.isin(sorted(leads)))
    return df.where(reduce(or_, tests)) if tests else df.where(F.lit(False))


def _lead(net) -> str:
    digits = f"{int(net.network_address):0{net.max_prefixlen // 4}X}"
    whole, rest = divmod(net.prefixlen, 4)
    return digits[:whole] + (f":{int(digits[whole], 16) >> (4 - rest)}" if rest else "")
