"""Part of evidentia; see the package README."""
