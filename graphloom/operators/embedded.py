"""Firmware seen from its code: tasks, interrupt handlers, peripherals, memory settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How tasks are created (pattern, group of the name, group of the function), by family.
TASKS = {
    "freertos": [(r"xTaskCreate\s*\(\s*(\w+)\s*,\s*[\"']([^\"']+)[\"']", 2, 1), (r"xTaskCreateStatic\s*\(\s*(\w+)\s*,\s*[\"']([^\"']+)[\"']", 2, 1), (r"xTaskCreatePinnedToCore\s*\(\s*(\w+)\s*,\s*[\"']([^\"']+)[\"']", 2, 1), (r"xTaskCreateRestricted\s*\(\s*[^,]+,\s*[\"']([^\"']+)[\"']", 1, 1)],
    "zephyr": [(r"K_THREAD_DEFINE\s*\(\s*(\w+)", 1, 1), (r"k_thread_create\s*\(\s*&(\w+)", 1, 1)],
}
# How interrupt handlers are declared, and for which family of controllers.
HANDLERS = [
    (r"void\s+(\w+_IRQHandler)\s*\(", "STM32"), (r"void\s+IRAM_ATTR\s+(\w+)\s*\(", "ESP32"), (r"IRAM_ATTR\s+void\s+(\w+)\s*\(", "ESP32"), (r"ISR\s*\(\s*(\w+)\s*\)", "Arduino"),
    (r"__interrupt\s+void\s+(\w+)", "MSP430"), (r"#pragma\s+vector\s*=\s*(\w+)\s*", "MSP430"), (r"void\s+(handleISR)\s*\(", "ESP32"), (r"static\s+void\s+IRAM_ATTR\s+(\w+)\s*\(", "ESP32"),
]
HANDLER_NAME = r"(_IRQHandler|_Handler|ISR)$|^ISR_"
# Names of peripherals and their interfaces, and the peripheral each name is counted under.
PERIPHERALS = (
    "GPIO", "UART", "SPI", "I2C", "ADC", "DAC", "PWM", "TIM", "TIM1", "TIM2", "TIM3", "TIM4", "USART", "USART1", "USART2", "SPI1", "SPI2", "I2C1", "I2C2", "DMA", "DMA1", "DMA2", "NVIC", "SCB", "SysTick", "RCC", "PWR", "FLASH", "RTC", "WDG", "IWDG", "WWDG",
    "gpio", "uart", "spi", "i2c", "adc", "dac", "ledc", "timer", "pcnt", "mcpwm", "digitalWrite", "digitalRead", "analogRead", "analogWrite", "pinMode", "delay", "millis", "micros", "Wire", "Serial", "BLEDevice", "WiFi", "Preferences", "SPIFFS", "LittleFS",
    "EEPROM", "i2s", "I2S", "audio", "Audio", "TFT", "tft", "display", "Display", "lcd", "LCD", "sensor", "Sensor", "imu", "IMU", "accel", "gyro",
)
PERIPHERAL_GROUPS = {
    "i2s": "I2S", "imu": "IMU", "gyro": "IMU", "accel": "IMU", "lcd": "LCD", "tft": "LCD", "display": "LCD", "spi2": "SPI", "spi1": "SPI", "spi": "SPI", "i2c2": "I2C", "i2c1": "I2C", "wire": "I2C", "i2c": "I2C", "sensor": "Sensor", "sensors": "Sensor",
    "gpio": "GPIO", "uart": "UART", "serial": "UART", "bledevice": "BLE", "bluetooth": "BLE", "wifi": "WiFi", "audio": "Audio", "pwr": "Power", "timer": "Timer", "adc": "ADC", "dac": "DAC", "dma": "DMA", "rtc": "RTC", "pwm": "PWM",
}
MEMORY = r"(STACK_SIZE|HEAP_SIZE)\s*=\s*(\d+)"


def tasks(code: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, task, function): the first task creation of each family in each code text."""
    found = []
    for family, patterns in TASKS.items():
        hit = F.coalesce(*[F.when(F.col(text).rlike(p), F.struct(F.lit(family).alias("family"), F.regexp_extract(text, p, n).alias("task"), F.regexp_extract(text, p, f).alias("function"))) for p, n, f in patterns])
        found.append(hit)
    return code.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("t")).select(key, "t.*")


def handlers(code: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """(key, handler, source): interrupt handlers by declaration, and by their name where no declaration tells (source null)."""
    found = [F.when(F.col(text).rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("handler"), F.lit(s).alias("source"))) for p, s in HANDLERS]
    if name:
        found.append(F.when(F.col(name).rlike(HANDLER_NAME), F.struct(F.col(name).alias("handler"), F.lit(None).cast("string").alias("source"))))
    return code.select(key, F.explode(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("h")).select(key, "h.*")


def peripherals(code: DataFrame, key: str, text: str) -> DataFrame:
    """(key, peripheral, access): peripherals whose registers, functions or objects a code text uses; ``access`` is
    write if it sets a control or data register, writes or begins, else read.

    One scan of the text finds all names; a name that ends in another one counts for that too.
    """
    any_ = "|".join(sorted(PERIPHERALS, key=len, reverse=True))
    tails = {p: [q for q in PERIPHERALS if q != p and p.endswith(q)] for p in PERIPHERALS}
    implied = F.create_map(*[x for p, qs in tails.items() if qs for x in (F.lit(p), F.array(*[F.lit(q) for q in qs]))])
    names = lambda suffix: F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({any_})(?:{suffix})"), F.lit(1)))
    wide = lambda a: F.array_distinct(F.concat(a, F.flatten(F.transform(a, lambda x: F.coalesce(F.try_element_at(implied, x), F.array().cast("array<string>"))))))
    rows = code.select(key, wide(names(r"->|_|\.|::")).alias("used"), wide(names(r"->CR|->DR|\.write|\.begin")).alias("set")).where(F.size("used") > 0)
    return rows.select(key, F.explode("used").alias("peripheral"), "set").select(key, "peripheral", F.when(F.array_contains("set", F.col("peripheral")), "write").otherwise("read").alias("access"))


def peripheral_group(name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PERIPHERAL_GROUPS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(name)), name)


def memory(code: DataFrame, key: str, text: str) -> DataFrame:
    """(key, setting, bytes): stack and heap sizes that code sets."""
    hits = F.regexp_extract_all(text, F.lit(MEMORY), F.lit(0))
    return code.select(key, F.explode(hits).alias("h")).select(key, F.regexp_extract("h", MEMORY, 1).alias("setting"), F.regexp_extract("h", MEMORY, 2).cast("long").alias("bytes"))
