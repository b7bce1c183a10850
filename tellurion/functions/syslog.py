"""RFC 3164 and 5424 lines as a map of texts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
MODERN = re.compile(r"(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) ?(.*)", re.S)
OLD = re.compile(r"([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) (?:([^\s:\[]+)(?:\[([^\]]*)\])?: ?)?(.*)", re.S)
ELEMENT = re.compile(r'\[([^\s\]]+)((?: [^\s=]+="(?:\\.|[^"\\])*")*)\]')
PARAMETER = re.compile(r' ([^\s=]+)="((?:\\.|[^"\\])*)"')
CEF = re.compile(r"CEF:(\d+)\|((?:\\.|[^|\\])*)\|((?:\\.|[^|\\])*)\|((?:\\.|[^|\\])*)\|((?:\\.|[^|\\])*)\|((?:\\.|[^|\\])*)\|((?:\\.|[^|\\])*)\|(.*)", re.S)


def parse(line: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if m := re.match(r"<(\d{1,3})>", line):
        n = int(m[1])
        out |= {"priority": str(n), "facility": str(n // 8), "severity": str(n % 8), "level": SEVERITIES[n % 8]}
        if n // 8 < len(FACILITIES):
            out["facility_keyword"] = FACILITIES[n // 8]
        line = line[m.end() :]
    if m := MODERN.fullmatch(line):
        _, when, host, app, process, kind, rest = m.groups()
        out["format"] = "rfc5424"
        for name, x in (("timestamp", when), ("hostname", host), ("app_name", app), ("proc_id", process), ("msg_id", kind)):
            if x != "-":
                out[name] = x
        if rest.startswith("["):
            at = 0
            while e := ELEMENT.match(rest, at):
                for name, x in PARAMETER.findall(e[2]):
                    out[f"{e[1]}.{name}"] = re.sub(r'\\(["\\\]])', r"\1", x)
                at = e.end()
            rest = rest[at:].removeprefix(" ")
        else:
            rest = rest.removeprefix("-").removeprefix(" ")
        message = rest
    elif m := OLD.fullmatch(line):
        out["format"] = "rfc3164"
        for name, x in (("timestamp", m[1]), ("hostname", m[2]), ("app_name", m[3]), ("proc_id", m[4])):
            if x:
                out[name] = x
        message = m[5]
    else:
        message = line
    if m := CEF.fullmatch(message):
        for name, x in zip(("version", "device_vendor", "device_product", "device_version", "device_event_class_id", "name", "severity"), m.groups()):
            out[f"cef.{name}"] = re.sub(r"\\([|\\])", r"\1", x)
        for name, x in re.findall(r"(\w+)=((?:\\=|[^=])*?)(?=\s+\w+=|$)", m[8]):
            out[f"cef.extension.{name}"] = x.replace("\\=", "=").strip()
    elif message.startswith("@cee:"):
        try:
            out |= {str(k): x if isinstance(x, str) else json.dumps(x) for k, x in json.loads(message[5:]).items()}
        except (ValueError, AttributeError):
            pass
    if message:
        out["message"] = message
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def syslog(text: pd.Series) -> pd.Series:
    return text.map(parse)
