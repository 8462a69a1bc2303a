"""Domain orders of the inspection data model (item bit order, display orders).

A bundle's NG bit *k* means item ``SPEC_ORDER[k]``; keeping this order makes
masks interchangeable with bundles built by other tools on the same data.
"""

from __future__ import annotations

# --- fixed values: base inspection items in spec order -----------------------
BASE_COLNAMES = (
    "Foreign_Length_Long",
    "Foreign_Length_Short",
    "Foreign_Size",
    "Lead_Length_L",
    "Lead_Length_R",
    "Lead_Pitch",
    "Work_Xw",
    "Work_Yw",
    "Work_Center_X",
    "Work_Center_Y",
    "Mark_Center_X",
    "Mark_Center_Y",
    "Defect_Length_Long",
    "Defect_Length_Short",
    "Defect_Size",
)
# --- fixed values: category and vision display orders -------------------------
CATEGORY_ORDER = ("異物", "リード", "PKGサイズ", "標印", "欠陥")
VISION_ORDER = ("vision_1", "vision_2", "vision_3")
# -----------------------------------------------------------------------------

# Each base item is measured by the three visions: item = base + "_v" + k.
SPEC_ORDER = tuple(f"{base}_v{k}" for base in BASE_COLNAMES for k in (1, 2, 3))
