"""The extraction lifecycle and documentation views."""
