"""Session helpers of the subpackage, under the names that its modules use."""

from __future__ import annotations

from polyglint.session import BROADCAST_BYTES, discard, fits, partitions_for, shared_folder, shuffle_partitions, small
from polyglint.session import saved as written

__all__ = ["BROADCAST_BYTES", "discard", "fits", "partitions_for", "shared_folder", "shuffle_partitions", "small", "written"]
