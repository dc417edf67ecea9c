"""Where records come from: rolling files, growing files and JSON text."""
