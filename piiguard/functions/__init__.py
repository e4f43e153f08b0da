"""Part of piiguard."""
