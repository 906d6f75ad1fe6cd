"""folioflow subpackage."""
