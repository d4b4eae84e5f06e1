"""What this runs on."""

from __future__ import annotations

import platform
import sys


def sysinfo() -> str:
    """Print and return the versions of Python, Spark and the machine."""
    import numpy
    import pandas
    import pyarrow
    import pyspark

    text = "\n".join(
        [f"Python {sys.version.split()[0]}", f"Spark {pyspark.__version__}", f"NumPy {numpy.__version__}", f"pandas {pandas.__version__}", f"Arrow {pyarrow.__version__}", f"System {platform.platform()}"]
    )
    print(text)
    return text
