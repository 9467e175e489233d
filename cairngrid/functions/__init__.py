"""Part of cairngrid."""
