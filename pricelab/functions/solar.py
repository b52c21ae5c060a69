"""Solar output estimate from cloud cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clear-sky irradiance in W/m^2, default panel area in m^2 and
# default panel efficiency.
MAX_RADIATION_W_M2 = 1000.0
PANEL_AREA_M2 = 100.0
PANEL_EFFICIENCY = 0.2


def solar_estimate_kw(cloud_cover, panel_area: float = PANEL_AREA_M2,
                      panel_efficiency: float = PANEL_EFFICIENCY) -> Column:
    """kW = irradiance * (1 - cloud/100) * area * efficiency / 1000."""
    cc = F.col(cloud_cover) if isinstance(cloud_cover, str) else cloud_cover
    radiation = F.lit(MAX_RADIATION_W_M2) * (F.lit(1.0) - cc / F.lit(100.0))
    return radiation * F.lit(float(panel_area)) * F.lit(float(panel_efficiency)) / F.lit(1000.0)
