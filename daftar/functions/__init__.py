"""Part of daftar."""
