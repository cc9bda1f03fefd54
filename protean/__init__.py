"""Spark-native analytics over macromolecular structures and the tables derived from them."""

import os as _os
import site as _site
import sys as _sys


def _reachable() -> bool:
    """Whether workers, which share the environment and the folder, can import this package themselves."""
    home = _os.path.dirname(_os.path.dirname(_os.path.abspath(__file__)))
    places = [*_os.environ.get("PYTHONPATH", "").split(_os.pathsep), _os.getcwd(), *_site.getsitepackages()]
    return any(p and _os.path.realpath(p) == _os.path.realpath(home) for p in places)


if not _reachable():
    from pyspark import cloudpickle as _cloudpickle

    # else functions travel to executors by value
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
