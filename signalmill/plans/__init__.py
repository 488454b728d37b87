"""Rules, findings, processing plans and decisions over measured tables."""
