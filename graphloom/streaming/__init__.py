"""Streaming analogues (an extension; see windows)."""
