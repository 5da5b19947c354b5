"""Query plans over the driver tables."""

import importlib
import pkgutil


def load():
    """Import every plan module; gives the registry that holds them."""
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
