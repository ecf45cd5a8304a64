"""Texts and limits that appear in the results and must not be changed."""

# Days to the end of support below which a runtime is critical, or in the warning range.
CRITICAL_DAYS = 180
WARNING_DAYS = 365

# Sort key of a runtime without long-term support, and of a supported one without an end date.
NON_LTS_SORT_KEY = -1
UNDATED_SORT_KEY = 9999

# Generation assumed for a VM type whose name has none: never below a threshold.
UNKNOWN_GENERATION = 99

# Runtime support status.
CRITICAL_NON_LTS = "🔴 CRITICAL (Non-LTS)"
EXPIRED = "⛔ EXPIRED"
CRITICAL_SIX_MONTHS = "🔴 CRITICAL (<6 months)"
WARNING_ONE_YEAR = "🟠 WARNING (<1 year)"
CRITICAL = "🔴 CRITICAL"
WARNING = "🟠 WARNING"
SUPPORTED = "🟢 SUPPORTED"

# Runtime version type, family prefix and the end-of-support text of a runtime without long-term support.
LTS = "LTS"
NON_LTS = "Non-LTS"
FAMILY_PREFIX = "DBR "
NO_END_OF_SUPPORT = "Non-LTS (Short Support)"

# Kind of runtime image.
ML_RUNTIME = "🤖 ML Runtime"
GPU_RUNTIME = "🎮 GPU Runtime"
STANDARD_RUNTIME = "📊 Standard Runtime"

# VM generation.
NO_GENERATION = "N/A"
BELOW_RECOMMENDED = "🔴 Below Recommended"
BELOW_THRESHOLD = "🔴 Below Threshold"
MEETS_THRESHOLD = "🟢 Meets Threshold"

# Driver sizing.
VCPUS_TOO_HIGH = "🔴 vCPUs Too High"
MEMORY_TOO_HIGH = "🟠 Memory Too High"
APPROPRIATELY_SIZED = "🟢 Appropriately Sized"
DRIVER_CORES_FOR_E8 = 32
DRIVER_CORES_FOR_E4 = 16
CONSIDER_E8 = "Consider Standard_E8ds_v5 (8 vCPU, 64GB)"
CONSIDER_E4 = "Consider Standard_E4ds_v5 (4 vCPU, 32GB)"
REVIEW_WORKLOAD = "Review workload requirements"

# Bottlenecks.
MEMORY_BOUND = "Memory-bound"
IO_BOUND = "I/O-bound"
CPU_BOUND = "CPU-bound"
BALANCED = "Balanced/Underutilized"
FIX_CPU_BOUND = "⚡ Enable Photon, compute-optimized, larger nodes, or more workers"
FIX_IO_BOUND = "💾 Delta Cache, Liquid Clustering for file pruning, storage-optimized"
FIX_MEMORY_BOUND = "🧠 Memory-optimized , larger nodes, or more workers"
FIX_NOTHING = "✅ No immediate action needed"

# High CPU.
CPU_HIGH_ML = "🟠 ML Runtime - Photon helps Spark SQL/feature eng; or compute-optimized"
CPU_LOW_ML = "🟡 ML Runtime - Evaluate if using Spark SQL/DataFrames"
CPU_HIGH = "🔴 CPU-bound - Photon, larger nodes, more workers"
CPU_LOW = "🟢 Below threshold - Not CPU-bound"

# High I/O wait.
IO_VERY_HIGH = "🔴 HIGH - Delta Cache + Liquid Clustering for file pruning"
IO_HIGH = "🟠 I/O-bound - Delta Cache, Liquid Clustering"
IO_MODERATE = "🟡 MODERATE - Consider Liquid Clustering for file pruning"

# High memory.
MEMORY_SWAPPING = "🔴 SWAPPING - larger nodes, more workers"
MEMORY_HIGH = "🟠 Memory-bound - larger nodes, more workers"
MEMORY_MODERATE = "🟡 MODERATE - Monitor for memory pressure"

# Executive summary: category and action.
RUNTIME_CRITICAL = ("🔴 DBR Critical (Non-LTS or <6mo to EOS)", "Immediate upgrade to LTS required")
RUNTIME_WARNING = ("🟠 DBR Warning (<1 year to EOS)", "Plan upgrade within 6 months")
OLD_VM = ("🔸 Older VM Generations (Below Threshold)", "Upgrade VMs to recommended generation")
OVERSIZED_DRIVER = ("🔸 Oversized Driver Nodes", "Right-size driver configurations")
