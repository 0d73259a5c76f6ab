"""Standard attribute names and their short forms."""

from __future__ import annotations

#: The attributes of the public XES extensions, by prefix. In lower case, NAME stands for PREFIX:NAME.
STANDARD: dict[str, tuple[str, ...]] = {
    "identity": ("id",),
    "concept": ("name", "instance"),
    "time": ("timestamp",),
    "org": ("resource", "role", "group"),
    "lifecycle": ("transition", "state", "model"),
    "cost": ("total", "currency", "amount", "driver", "type", "drivers"),
    "semantic": ("modelReference",),
    "artifactlifecycle": ("moves",),
    "micro": ("level", "parentId", "length"),
    "swcomm": ("localHost", "localPort", "remoteHost", "remotePort"),
    "swevent": ("hasData", "hasException", "returnValue", "appName", "threadId", "nanotime", "exThrown", "exCaught"),
    "swtelemetry": ("cpuTotalUser", "cpuLoadUser", "memoryUsed", "memoryTotal"),
    "meta_general": ("traces_total", "events_total", "events_average"),
    "meta_time": ("log_duration", "duration_average"),
    "xes": ("version", "features"),
}
ALIASES = {name.lower(): f"{prefix}:{name}" for prefix, names in STANDARD.items() for name in names}
#: Implicit classifiers: parts are joined by +.
CLASSIFIERS = {"event name": ("concept:name", "lifecycle:transition"), "resource": ("org:resource",)}


def standard_name(name: str, literal: bool) -> str:
    """The full attribute name; a bracketed name is exact."""
    return name if literal else ALIASES.get(name, name)
