"""Query plans over the given tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``q_*`` module so that its queries are registered."""
    for module in sorted(m.name for m in iter_modules(__path__) if m.name.startswith("q_")):
        import_module(f"{__name__}.{module}")
