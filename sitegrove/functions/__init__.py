"""Part of sitegrove."""
