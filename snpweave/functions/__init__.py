"""Part of snpweave."""
