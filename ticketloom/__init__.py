"""Support-text analytics as DataFrame operators."""
