"""The row-wise tools on streams.

Rounding and suppression look at one row at a time, so ``confidentialise`` takes
a streaming frame and gives one; no state, no watermark.
"""

from tabloom.operators.confidential import run_confidential as confidentialise

__all__ = ["confidentialise"]
