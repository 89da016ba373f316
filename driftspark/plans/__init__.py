from .drift import drift_report, shared_bodies
from .listing import export_routines, split_listing
from .settings import connection_fields, connections, effective_settings

__all__ = [
    "connection_fields",
    "connections",
    "drift_report",
    "effective_settings",
    "export_routines",
    "shared_bodies",
    "split_listing",
]
